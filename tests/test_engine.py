import json
import os
import struct

import pytest

from tensorloom.errors import AlreadyExists, EngineError, InvalidArtifact, InvalidJson, InvalidPlan, InvalidTensor, MemoryLimitExceeded, OutputCorrupted, PathEscape, ResumeMismatch, UnsupportedArchitecture
from tensorloom.operators.checks import LAYER
from tensorloom.plans import documents as doc
from tensorloom.plans.engine import CHECKPOINT, MANIFEST, Engine
from tensorloom.plans.plan import make_plan
from tensorloom.sources import safetensors as st

DIMS = {"hidden": 2, "inner": 2, "kv": 2, "vocab": 3}


def model_tensors(tied=True, dtype="F32", vocab=3):
    dims = DIMS | {"vocab": vocab}
    names = {f"model.layers.0.{n}": s for n, s in LAYER.items()} | {st.EMBEDDING: ("vocab", "hidden"), "model.norm.weight": ("hidden",)}
    if not tied:
        names[st.HEAD] = ("vocab", "hidden")
    return [st.Tensor(n, dtype, tuple(dims[d] for d in s)) for n, s in sorted(names.items())]


def write_file(path, tensors, start=1):
    """Payload bytes count up from `start`, so that every row differs."""
    data, value = b"", start
    for t in tensors:
        data += bytes((value + i) % 251 for i in range(t.byte_length))
        value += t.byte_length
    path.write_bytes(st.encode_header(tensors) + data)


def write_model(folder, tied=True, split=None, **config):
    folder.mkdir()
    settings = {"model_type": "llama", "hidden_size": 2, "intermediate_size": 2, "num_attention_heads": 1, "num_hidden_layers": 1, "vocab_size": 3, "tie_word_embeddings": tied} | config
    (folder / st.CONFIG).write_text(json.dumps(settings))
    (folder / "tokenizer.json").write_text("{}")
    tensors = model_tensors(tied)
    if split:
        write_file(folder / "a.safetensors", tensors[:split])
        write_file(folder / "b.safetensors", tensors[split:], 1 + sum(t.byte_length for t in tensors[:split]))
        names = {t.name: ("a" if i < split else "./b") + ".safetensors" for i, t in enumerate(tensors)}
        (folder / st.INDEX).write_text(json.dumps({"metadata": {"total_size": sum(t.byte_length for t in tensors)}, "weight_map": names}))
    else:
        write_file(folder / st.SINGLE, tensors)
    return folder


def payloads(spark, folder):
    out = {}
    for r in st.read_rows(spark, str(folder)).collect():
        out.setdefault(r["tensor"], {})[r["row_id"]] = bytes(r["raw"])
    return {n: b"".join(v for _, v in sorted(x.items())) for n, x in out.items()}


def test_identity_repacks_without_changing_a_byte(spark, tmp_path):
    source, engine = write_model(tmp_path / "m", split=5), Engine(spark)
    manifest = engine.transform(str(source), str(tmp_path / "out"))
    assert payloads(spark, tmp_path / "out") == payloads(spark, source)
    assert (tmp_path / "out" / "tokenizer.json").read_text() == "{}"
    assert not (tmp_path / "out" / st.INDEX).exists()
    assert engine.verify(str(tmp_path / "out"))["scope"] == "current"
    small = engine.transform(str(source), str(tmp_path / "small"), max_shard=16)
    assert len(small["plan"]["layout"]) > 1
    assert payloads(spark, tmp_path / "small") == payloads(spark, source)
    one = [engine.fingerprint(st.open_artifact(str(tmp_path / n))) for n in ("m", "out", "small")]
    assert len(set(one)) == 1  # sharding has no part in it
    assert engine.transform(str(source), str(tmp_path / "out")) == manifest  # the same plan, again
    with pytest.raises(AlreadyExists):
        engine.transform(str(source), str(tmp_path / "out"), max_shard=16)


@pytest.mark.parametrize("tied", [True, False])
def test_token_permutation(spark, tmp_path, tied):
    source, engine = write_model(tmp_path / "m", tied=tied), Engine(spark)
    secret = engine.create_secret(str(source), str(tmp_path / "secret.json"))
    assert os.stat(tmp_path / "secret.json").st_mode & 0o777 == 0o600
    with pytest.raises(FileExistsError):
        engine.create_secret(str(source), str(tmp_path / "secret.json"))
    engine.transform(str(source), str(tmp_path / "out"), "token-permutation", str(tmp_path / "secret.json"))
    before, after = payloads(spark, source), payloads(spark, tmp_path / "out")
    for name, data in before.items():
        rows = [data[i : i + 8] for i in range(0, len(data), 8)]
        if name in (st.EMBEDDING, st.HEAD):
            for i, j in enumerate(secret["permutation"]):
                assert after[name][8 * j : 8 * j + 8] == rows[i]
        else:
            assert after[name] == data
    text = (tmp_path / "out" / MANIFEST).read_text()
    assert secret["nonce"] not in text and "permutation\":[" not in text
    other = write_model(tmp_path / "other", tied=tied, rope_theta=2)
    with pytest.raises(InvalidPlan, match="another artifact"):
        engine.transform(str(other), str(tmp_path / "x"), "token-permutation", str(tmp_path / "secret.json"))
    broken = json.loads((tmp_path / "secret.json").read_text())
    broken["permutation"] = broken["permutation"][::-1]
    (tmp_path / "broken.json").write_text(json.dumps(broken))
    with pytest.raises(InvalidPlan):
        engine.load_secret(str(tmp_path / "broken.json"))


def test_padding(spark, tmp_path):
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / st.CONFIG).write_text(json.dumps({"model_type": "pads", "hidden_size": 2}))
    tensors = [st.Tensor("embed", "F32", (3, 2)), st.Tensor("norm", "F32", (2,)), st.Tensor("renamed.source.weight", "F32", (2, 2))]
    data = struct.pack("<12f", *range(1, 13))
    (folder / st.SINGLE).write_bytes(st.encode_header(tensors) + data)
    Engine(spark).transform(str(folder), str(tmp_path / "out"), "expand-test", expansion=1, max_shard=48)
    found = {n: struct.unpack(f"<{len(v) // 4}f", v) for n, v in payloads(spark, tmp_path / "out").items()}
    assert found == {"embed": (1, 2, 0, 0, 3, 4, 0, 0, 5, 6, 0, 0), "norm": (7, 8), "renamed.target.weight": (9, 10, 0, 0, 11, 12, 0, 0)}
    assert (tmp_path / "out" / st.INDEX).exists()


def test_resume_keeps_whole_shards_and_sees_tampering(spark, tmp_path, monkeypatch):
    source, engine = write_model(tmp_path / "m"), Engine(spark)
    monkeypatch.setattr(Engine, "verify", lambda self, path: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        engine.transform(str(source), str(tmp_path / "out"), max_shard=40)
    monkeypatch.undo()
    stage = tmp_path / ".out.work"
    plan = engine.plan(str(source), max_shard=40)
    state = json.loads((stage / MANIFEST).read_text())
    assert state["plan_hash"] == plan.hash
    (stage / MANIFEST).unlink()
    # as after a stop before the last shard
    digest = {t["name"]: t["digest"] for t in state["tensors"]}
    whole = {s.filename: {t.name: digest[t.name] for t in s.tensors} for s in plan.shards[:-1]}
    (stage / CHECKPOINT).write_text(json.dumps(doc.contract(plan) | {"shards": whole}))
    (stage / plan.shards[-1].filename).unlink()
    with pytest.raises(ResumeMismatch):
        engine.transform(str(source), str(tmp_path / "out"), max_shard=16)
    first = stage / plan.shards[0].filename
    good = first.read_bytes()
    first.write_bytes(good[:-1] + bytes([good[-1] ^ 1]))
    with pytest.raises(OutputCorrupted):
        engine.transform(str(source), str(tmp_path / "out"), max_shard=40)
    first.write_bytes(good)
    (stage / "stray.safetensors").write_bytes(b"")
    with pytest.raises(ResumeMismatch):
        engine.transform(str(source), str(tmp_path / "out"), max_shard=40)
    (stage / "stray.safetensors").unlink()
    engine.transform(str(source), str(tmp_path / "out"), max_shard=40)
    assert payloads(spark, tmp_path / "out") == payloads(spark, source)


def test_verify_sees_a_changed_byte(spark, tmp_path):
    source, engine = write_model(tmp_path / "m"), Engine(spark)
    engine.transform(str(source), str(tmp_path / "out"))
    file = tmp_path / "out" / st.SINGLE
    data = file.read_bytes()
    file.write_bytes(data[:-1] + bytes([data[-1] ^ 1]))
    with pytest.raises(OutputCorrupted):
        engine.verify(str(tmp_path / "out"))
    found = engine.verify(str(source))
    assert found["scope"] == "container" and found["tensors"] == 11 and found["payload_bytes"] == sum(t.byte_length for t in model_tensors())


def test_input_and_output_apart(spark, tmp_path):
    source = write_model(tmp_path / "m")
    for output in (source, source / "in", tmp_path):
        with pytest.raises(InvalidPlan):
            Engine(spark).transform(str(source), str(output))


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({"model_type": "gpt2"}, UnsupportedArchitecture),
        ({"num_attention_heads": 0}, UnsupportedArchitecture),
        ({"num_key_value_heads": 4}, UnsupportedArchitecture),
        ({"hidden_size": 3}, UnsupportedArchitecture),
        ({"vocab_size": 4}, UnsupportedArchitecture),
        ({"vocab_size": None}, UnsupportedArchitecture),
        ({"num_hidden_layers": 2}, UnsupportedArchitecture),
        ({"tie_word_embeddings": False}, UnsupportedArchitecture),
    ],
)
def test_models_that_are_not_supported(tmp_path, change, error):
    artifact = st.open_artifact(str(write_model(tmp_path / "m", **change)))
    with pytest.raises(error):
        make_plan(artifact, "identity", "f")


def test_plan_limits(tmp_path):
    artifact = st.open_artifact(str(write_model(tmp_path / "m")))
    with pytest.raises(MemoryLimitExceeded):
        make_plan(artifact, "identity", "f", memory_limit=256 * 22)
    plan = make_plan(artifact, "identity", "f", memory_limit=256 * 22 + 1)
    assert plan.peak_bytes == 256 * 22 + 1
    with pytest.raises(InvalidPlan):
        make_plan(artifact, "token-permutation", "f")
    assert plan.hash != make_plan(artifact, "identity", "f", max_shard=8).hash


def header(entries, payload=b"", size=None):
    text = entries if isinstance(entries, bytes) else json.dumps(entries).encode()
    return struct.pack("<Q", len(text) if size is None else size) + text + payload


GOOD = {"dtype": "U8", "shape": [2], "data_offsets": [0, 2]}


@pytest.mark.parametrize(
    ("data", "error"),
    [
        (b"123", InvalidArtifact),
        (header({}, size=(1 << 64) - 1), InvalidArtifact),
        (header({}, size=99), InvalidArtifact),
        (header(b'{"a": {"dtype": "U8", "dtype": "U8", "shape": [2], "data_offsets": [0, 2]}}', b"xx"), InvalidJson),
        (header({"a": GOOD}, b"x"), InvalidTensor),
        (header({"a": GOOD | {"shape": [3]}}, b"xx"), InvalidTensor),
        (header({"a": GOOD | {"dtype": "F8"}}, b"xx"), EngineError),
        (header({"a": GOOD, "b": {"dtype": "U8", "shape": [2], "data_offsets": [1, 3]}}, b"xxx"), InvalidArtifact),
        (header({"a": GOOD, "b": {"dtype": "U8", "shape": [1], "data_offsets": [3, 4]}}, b"xxxx"), InvalidArtifact),
        (header({"a": GOOD}, b"xxx"), InvalidArtifact),
    ],
)
def test_malformed_headers(data, error):
    with pytest.raises(error):
        st.parse_header(data, len(data), "x")


def test_empty_tensor_is_valid():
    data = header({"a": GOOD, "n": {"dtype": "F32", "shape": [0], "data_offsets": [0, 0]}, "__metadata__": {"format": "pt"}}, b"xx")
    tensors, claimed = st.parse_header(data, len(data), "x")
    assert [t.name for t in tensors] == ["n", "a"] and claimed == "pt"


@pytest.mark.parametrize("shard", ["../x", "/x", "link/x"])
def test_paths_stay_inside(tmp_path, shard):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "link").symlink_to(tmp_path)
    with pytest.raises(PathEscape):
        st.inside((tmp_path / "r").resolve(), shard)


def test_index_must_agree(tmp_path):
    folder = write_model(tmp_path / "m", split=5)
    index = json.loads((folder / st.INDEX).read_text())
    for name, change in (("wrong shard", {model_tensors()[0].name: "b.safetensors"}), ("no such", {"nothing": "a.safetensors"})):
        (folder / st.INDEX).write_text(json.dumps(index | {"weight_map": index["weight_map"] | change}))
        with pytest.raises(InvalidArtifact):
            st.open_artifact(str(folder))
        assert name
    (folder / st.INDEX).write_text(json.dumps(index | {"metadata": {"total_size": 1}}))
    with pytest.raises(InvalidArtifact):
        st.open_artifact(str(folder))
    write_file(folder / st.SINGLE, model_tensors())
    with pytest.raises(InvalidArtifact):
        st.open_artifact(str(folder))


def test_command_line(spark, tmp_path, capsys):
    from tensorloom.__main__ import main

    source = str(write_model(tmp_path / "m"))
    assert main(["inspect", source]) == 0
    assert json.loads(capsys.readouterr().out)["tensor_count"] == 11
    assert main(["plan", source, "--identity", "--max-shard-size", "16 B"]) == 0
    assert json.loads(capsys.readouterr().out)["operations"] == 11
    assert main(["plan", source, "--method", "token-permutation"]) == 1
    assert main(["transform", source, "--method", "token-permutation", "--output", str(tmp_path / "o")]) == 1
    assert main(["transform", source, "--method", "token-permutation", "--output", str(tmp_path / "o"), "--secret-output", str(tmp_path / "s")]) == 0
    capsys.readouterr()
    assert main(["verify", str(tmp_path / "o")]) == 0
    assert json.loads(capsys.readouterr().out)["scope"] == "current"
    for bad in (["plan", source, "--identity", "--memory-limit", "3kib"], ["plan", source], ["plan", source, "--identity", "--method", "identity"]):
        with pytest.raises(SystemExit):
            main(bad)


def test_sidecars_are_carried_along(spark, tmp_path):
    source, engine = write_model(tmp_path / "m"), Engine(spark)
    names = ("generation_config.json", "tokenizer.json", "tokenizer_config.json", "special_tokens_map.json", "vocab.json", "merges.txt")
    for name in names:
        (source / name).write_text(f"of {name}")
    (source / "other.txt").write_text("not of the model")
    engine.transform(str(source), str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir()} == {*names, st.CONFIG, st.SINGLE, MANIFEST}
    assert all((tmp_path / "out" / n).read_text() == f"of {n}" for n in names)
    (tmp_path / "out" / "merges.txt").write_text("changed")
    with pytest.raises(OutputCorrupted, match=r"merges\.txt"):
        engine.verify(str(tmp_path / "out"))


SECRET = doc.new_secret("ab" * 32, [2, 0, 4, 1, 3], "07" * 32)


def committed(**change):
    """The secret with other fields, and an id that fits them."""
    secret = SECRET | change
    return secret | {"secret_id": doc.commitment(secret)}


@pytest.mark.parametrize(
    "secret",
    [
        SECRET | {"version": 2},
        SECRET | {"method": {"id": "token-permutation", "version": "0.2"}},
        SECRET | {"method": {"id": "token-permutation", "version": "0.1", "more": 1}},
        SECRET | {"more": 1},
        {k: v for k, v in SECRET.items() if k != "nonce"},
        SECRET | {"source_fingerprint": "AB" * 32},
        SECRET | {"nonce": "07" * 31},
        SECRET | {"nonce": "0A" * 32},
        committed(permutation=[0, 1, 2, 3, 4], inverse=[0, 1, 2, 3, 4]),
        committed(inverse=[1, 3, 0, 4, 1]),
        committed(inverse=[0, 1, 2, 3, 4]),
        committed(permutation=[2, 0, 4, 1, 1]),
        SECRET | {"permutation": [2, 0, 4, 1, 5]},
        SECRET | {"permutation": [2, 0, 4, 1, True]},
        committed(vocab_size=4),
        doc.new_secret("ab" * 32, [0], "07" * 32),
        SECRET | {"secret_id": "00" * 32},
        [],
    ],
)
def test_secrets_that_are_refused(tmp_path, secret):
    assert doc.check_secret(SECRET) is None
    file = tmp_path / "secret.json"
    file.write_text(json.dumps(secret))
    with pytest.raises(EngineError):
        doc.read_secret(file)


def test_secret_files_that_are_refused(tmp_path, monkeypatch):
    file = tmp_path / "secret.json"
    file.write_text(json.dumps(SECRET)[:-1] + ', "version": 1}')
    with pytest.raises(InvalidJson):
        doc.read_secret(file)
    file.write_text(json.dumps(SECRET))
    assert doc.read_secret(file) == SECRET
    (tmp_path / "link").symlink_to(file)
    with pytest.raises(InvalidPlan):
        doc.read_secret(tmp_path / "link")
    monkeypatch.setattr(doc, "SECRET_LIMIT", 10)
    with pytest.raises(InvalidPlan):
        doc.read_secret(file)


def test_secret_lies_outside(spark, tmp_path):
    source, engine = write_model(tmp_path / "m"), Engine(spark)
    for place in (source / "s.json", tmp_path / "out" / "s.json", tmp_path / ".out.work" / "s.json"):
        with pytest.raises(InvalidPlan):
            engine.create_secret(str(source), str(place), str(tmp_path / "out"))
        with pytest.raises(InvalidPlan):
            engine.transform(str(source), str(tmp_path / "out"), "token-permutation", str(place))
    (tmp_path / "link").symlink_to(source / "s.json")
    with pytest.raises(InvalidPlan):
        engine.create_secret(str(source), str(tmp_path / "link"))


def test_tied_weights_must_be_equal(spark, tmp_path):
    """Tied by the config and both there, with other bytes: they can't both be permuted."""
    source, engine = write_model(tmp_path / "m", tied=False, tie_word_embeddings=True), Engine(spark)
    engine.create_secret(str(source), str(tmp_path / "s"))
    with pytest.raises(InvalidTensor, match="tied"):
        engine.transform(str(source), str(tmp_path / "out"), "token-permutation", str(tmp_path / "s"))
    assert engine.transform(str(source), str(tmp_path / "same"))["standard"] is True  # an identity keeps them as they are


def test_nothing_is_replaced(spark, tmp_path, monkeypatch):
    """An empty folder that appears under the output's name before it is published stays."""
    source, engine = write_model(tmp_path / "m"), Engine(spark)
    whole = Engine.verify

    def appears(self, path):
        (tmp_path / "out").mkdir()
        return whole(self, path)

    monkeypatch.setattr(Engine, "verify", appears)
    with pytest.raises(AlreadyExists):
        engine.transform(str(source), str(tmp_path / "out"))
    assert not list((tmp_path / "out").iterdir())


def test_a_source_that_changes(spark, tmp_path, monkeypatch):
    source, engine = write_model(tmp_path / "m"), Engine(spark)
    write = Engine._write

    def changes(self, *args):
        file = source / st.SINGLE
        data = file.read_bytes()
        file.write_bytes(data[:-1] + bytes([data[-1] ^ 1]))
        return write(self, *args)

    monkeypatch.setattr(Engine, "_write", changes)
    with pytest.raises(InvalidTensor, match="changed"):
        engine.transform(str(source), str(tmp_path / "out"))


@pytest.fixture(scope="module")
def manifest(spark, tmp_path_factory):
    """A model in several shards, its output and its manifest."""
    folder = tmp_path_factory.mktemp("whole")
    return write_model(folder / "m"), folder / "out", Engine(spark).transform(str(folder / "m"), str(folder / "out"), max_shard=40)


@pytest.mark.parametrize("field", ["method", "architecture", "source_fingerprint", "plan_hash", "layout_hash", "layout", "runtime", "standard", "secret_id", "plan", "artifact_version"])
def test_manifests_that_are_not_their_plans(manifest, field):
    _, _, good = manifest
    assert doc.check_manifest(good).hash == good["plan_hash"]
    with pytest.raises(EngineError):
        doc.check_manifest(good | {field: "another"})
    if field not in ("secret_id", "method", "architecture"):
        with pytest.raises(EngineError):
            doc.check_manifest({k: v for k, v in good.items() if k != field})


def test_older_manifests(manifest):
    _, _, good = manifest
    older = {k: v for k, v in good.items() if k not in ("plan", "runtime", "layout_hash")}
    token = {"method": doc.method_of(doc.TOKEN), "secret_id": "ab" * 32}
    assert doc.check_manifest(older | {"artifact_version": 1}) is None
    assert doc.check_manifest(older | {"artifact_version": 2} | token) is None
    for bad in ({"artifact_version": 1} | token, {"artifact_version": 2}, {"artifact_version": 2} | token | {"secret_id": "AB" * 32}, {"artifact_version": 1, "standard": False}, {"artifact_version": 1, "plan": good["plan"]}, {"artifact_version": 4}):
        with pytest.raises(EngineError):
            doc.check_manifest(older | bad)


def test_an_older_manifest_is_verified(spark, manifest):
    _, out, good = manifest
    older = {k: v for k, v in good.items() if k not in ("plan", "runtime", "layout_hash")} | {"artifact_version": 1}
    text = (out / MANIFEST).read_text()
    (out / MANIFEST).write_text(json.dumps(older))
    try:
        assert Engine(spark).verify(str(out))["scope"] == "legacy"
    finally:
        (out / MANIFEST).write_text(text)


def test_verify_sees_other_dimensions_and_shards(spark, manifest):
    _, out, good = manifest
    artifact, plan = st.open_artifact(str(out)), doc.check_manifest(good)
    digests = {t["name"]: t["digest"] for t in good["tensors"]}
    sizes = {s["filename"]: s["file_length"] for s in good["layout"]}
    assert doc.check_artifact(artifact, good, plan, digests, sizes) is None
    first = next(iter(sizes))
    for bad in ({first: sizes[first] + 8}, {"more.safetensors": 8}):
        with pytest.raises(OutputCorrupted):
            doc.check_artifact(artifact, good, plan, digests, sizes | bad)
    plan.logical = plan.logical | {"vocab_size": 9}
    with pytest.raises(OutputCorrupted, match="vocab_size"):
        doc.check_artifact(artifact, good, plan, digests, sizes)
    shards = [st.Shard(s["filename"], tuple(st.Tensor(t["name"], t["dtype"], tuple(t["shape"])) for t in s["tensors"])) for s in good["layout"]]
    text = st.index_of(shards)
    assert doc.check_index(text, shards) is None
    for bad in (None, text.replace("total_size\":", "total_size\":1"), json.dumps({"weight_map": {}})):
        with pytest.raises(InvalidArtifact):
            doc.check_index(bad, shards)


@pytest.mark.parametrize("change", [{"id": 1}, {"filename": "x"}, {"payload": 1}, {"file_length": 1}, {"tensors": []}])
def test_layouts_that_are_not_sound(manifest, change):
    layout = manifest[2]["layout"]
    with pytest.raises(InvalidArtifact):
        doc.check_layout([layout[0] | change, *layout[1:]])


def test_checkpoints_of_other_plans(spark, manifest):
    source, _, _ = manifest
    plan = Engine(spark).plan(str(source), max_shard=40)
    good = doc.contract(plan) | {"shards": {}}
    assert doc.check_checkpoint(good, plan) is None
    for field in doc.contract(plan):
        with pytest.raises(EngineError):
            doc.check_checkpoint(good | {field: "another"}, plan)
    with pytest.raises(ResumeMismatch):
        doc.check_checkpoint(good | {"shards": {"x": {}}}, plan)


def test_staging_must_be_the_same(spark, tmp_path):
    source = write_model(tmp_path / "m")
    plan, stage = Engine(spark).plan(str(source)), tmp_path / ".out.work"
    stage.mkdir()
    (stage / CHECKPOINT).write_text(json.dumps(doc.contract(plan) | {"shards": {}}))
    (stage / "tokenizer.json").write_text("[]")
    with pytest.raises(ResumeMismatch, match=r"tokenizer\.json"):
        Engine(spark).transform(str(source), str(tmp_path / "out"))
    assert (stage / "tokenizer.json").read_text() == "[]"


def test_binding_of_a_permuted_model(spark, tmp_path):
    source, engine = write_model(tmp_path / "m"), Engine(spark)
    secret = engine.create_secret(str(source), str(tmp_path / "s"))
    good = engine.transform(str(source), str(tmp_path / "out"), doc.TOKEN, str(tmp_path / "s"))
    config = json.loads((source / st.CONFIG).read_text())
    assert doc.check_binding(secret, config, config, good) is None
    for bad in ({"artifact_version": 1}, {"method": doc.method_of("identity")}, {"runtime": good["runtime"] | {"standard": False}}, {"standard": False}, {"plan": None}, {"plan_hash": "0"}, {"secret_id": "0"}, {"source_fingerprint": "0"}):
        with pytest.raises(EngineError):
            doc.check_binding(secret, config, config, good | bad)
    for a, b in ((config | {"x": 1}, config), (config | {"vocab_size": 9}, config | {"vocab_size": 9})):
        with pytest.raises(InvalidPlan):
            doc.check_binding(secret, a, b, good)


def test_architectures_and_executors_are_added(spark, tmp_path):
    from dataclasses import replace

    from tensorloom.errors import AmbiguousArchitecture
    from tensorloom.plans.registry import LLAMA, Executor

    other = replace(LLAMA, name="other", matches=lambda config: config.get("model_type") == "other")
    source = write_model(tmp_path / "m", model_type="other")
    with pytest.raises(UnsupportedArchitecture):
        Engine(spark).transform(str(source), str(tmp_path / "out"))
    assert Engine(spark, (other,)).transform(str(source), str(tmp_path / "out"))["architecture"] == "other"
    both = replace(other, name="both")
    with pytest.raises(AmbiguousArchitecture):
        Engine(spark, (other, both)).plan(str(source))
    with pytest.raises(AlreadyExists):
        Engine(spark, (LLAMA,))
    with pytest.raises(EngineError):
        Engine(spark).transform(str(source), str(tmp_path / "x"), "unheard of")
    plan = Engine(spark, (other,)).plan(str(source))
    for executor, secret in ((Executor("x", lambda r, p, q: r), None), (Executor("identity", lambda r, p, q: r), SECRET), (Executor("identity", lambda r, p, q: r, True), None)):
        with pytest.raises(EngineError):
            executor.accept(plan, secret)


def test_rows_are_pruned_by_filters(spark, tmp_path):
    """Only the ranges that filters leave are read, and a plan that has the source twice gives each side its own rows."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    source = write_model(tmp_path / "m")
    reader = st.PruningReader(str(source), None)
    asked = [EqualTo(("tensor",), st.EMBEDDING), GreaterThan(("row_id",), 0), LessThanOrEqual(("row_id",), 1)]
    assert list(reader.pushFilters(asked)) == asked
    assert [(p.tensor, p.first, p.last) for p in reader.partitions()] == [(st.EMBEDDING, 1, 2)]
    everything = {(r["tensor"], r["row_id"]): bytes(r["raw"]) for r in st.read_rows(spark, str(source)).collect()}
    load = lambda: st.read_rows(spark, str(source), pushdown=True)
    one, two = load().where(f"tensor = '{st.EMBEDDING}' AND row_id >= 1"), load().where("tensor = 'model.norm.weight'")
    found = {(r["tensor"], r["row_id"]): bytes(r["raw"]) for r in one.unionByName(two).collect()}
    assert found == {k: v for k, v in everything.items() if (k[0] == st.EMBEDDING and k[1] >= 1) or k[0] == "model.norm.weight"}
    assert one.join(two.withColumnRenamed("tensor", "t"), "row_id").count() == 1
    some = st.read_rows(spark, str(source), [st.EMBEDDING], (1, 1)).collect()
    assert [(r["tensor"], r["row_id"]) for r in some] == [(st.EMBEDDING, 1)]


def test_writing_through_the_source(spark, tmp_path):
    source, target = write_model(tmp_path / "m"), tmp_path / "w"
    tensors = json.dumps([[t.name, t.dtype, list(t.shape)] for t in model_tensors()])
    rows = st.read_rows(spark, str(source))

    def write(df, folder):
        df.repartition(3).write.format("safetensors").option("tensors", tensors).option("max_shard", 40).option("config", '{"model_type": "x"}').mode("append").save(str(folder))

    write(rows, target)
    assert payloads(spark, target) == payloads(spark, source)
    assert st.open_artifact(str(target)).config == {"model_type": "x"} and len(list(target.glob("*.safetensors"))) > 1
    for bad in (rows.where("row_id <> 1"), rows.unionByName(rows.where("row_id = 1"))):
        with pytest.raises(Exception, match="missing or repeated"):
            write(bad, tmp_path / "bad")
        assert not list((tmp_path / "bad").glob("*.safetensors"))
    with pytest.raises(Exception, match="AlreadyExists"):
        write(rows, target)


def test_digests_of_long_ranges(spark, tmp_path):
    from tensorloom.functions.blake3 import PIECE, blake3

    data = os.urandom(3 * PIECE + 77)
    (tmp_path / "f").write_bytes(data)
    ranges = [("all", 0, len(data)), ("none", 5, 0), ("part", 9, 2 * PIECE), ("short", 1, 1000)]
    found = st.range_digests(spark, [(n, str(tmp_path / "f"), a, size) for n, a, size in ranges])
    assert found == {n: blake3(data[a : a + size]).hexdigest() for n, a, size in ranges}


def test_workers_hold_no_payload(tmp_path):
    """The peak of the workers is the same for a payload of 4 and one of 24 MiB."""
    from tensorloom import peak

    found = [peak.peak_mib(n, tmp_path) for n in (4, 24)]
    assert abs(found[1] - found[0]) <= peak.SPREAD_MIB


def test_row_width_of_a_matrix():
    assert st.Tensor("t", "BF16", (3, 5)).matrix_row_bytes() == 10
    for shape in ((), (3,), (3, 0), (3, 5, 2)):
        with pytest.raises(InvalidTensor):
            st.Tensor("t", "F32", shape).matrix_row_bytes()
    with pytest.raises(EngineError, match="nothing"):
        st.Artifact("", b"", {}, [], []).required("nothing")

"""The engine: inspect, plan, transform and verify artifacts. Bytes go through Spark; documents and locks are the driver's."""

from __future__ import annotations

import ctypes
import errno
import fcntl
import os
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.errors import AlreadyExists, InvalidPlan, InvalidTensor, LockUnavailable, OutputCorrupted, ResumeMismatch
from tensorloom.functions.blake3 import Blake3, blake3
from tensorloom.operators import inventory as inv
from tensorloom.operators.permutation import permute_rows, secret_permutation
from tensorloom.plans import documents as doc
from tensorloom.plans.documents import CHECKPOINT, MANIFEST, TOKEN
from tensorloom.plans.plan import Plan, make_plan
from tensorloom.plans.registry import LLAMA, Architecture, Architectures, Executor, Executors
from tensorloom.sources.safetensors import CONFIG, EMBEDDING, HEAD, INDEX, Artifact, canonical_json, index_of, inventory, local, open_artifact, read_rows, shard_digests, strict_json, tensor_digests, write_rows

WORK = ".work"


def _sync(path: Path) -> None:
    fd = os.open(path, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


def _store(path: Path, text: str) -> None:
    """Writes a document so that either the old or the new one is there, whatever happens."""
    part = path.with_name(f".{path.name}.part")
    with part.open("w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
    _sync(path.parent)


@contextmanager
def _locked(output: Path):
    with output.with_name(f".{output.name}.lock").open("w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as error:
            raise LockUnavailable(str(output)) from error
        yield


def _rename_new(stage: Path, target: Path) -> None:
    """Gives a folder its name in one step, which fails if there is anything under that name, an empty folder too."""
    try:
        call = ctypes.CDLL(None, use_errno=True).renameat2
    except (OSError, AttributeError) as error:
        raise OSError(errno.ENOSYS, "this system can't rename without replacing") from error
    here, no_replace = -100, 1
    if call(here, os.fsencode(stage), here, os.fsencode(target), no_replace):
        number = ctypes.get_errno()
        if number == errno.EEXIST:
            raise AlreadyExists(str(target))
        raise OSError(number, os.strerror(number), str(target))


def copied_rows(rows: DataFrame, plan: Plan, perm: DataFrame | None = None) -> DataFrame:
    return rows


def padded_rows(rows: DataFrame, plan: Plan) -> DataFrame:
    """rows with zeros after those of padded tensors, under their output names."""
    outputs = {t.name: t for t in plan.output}
    pads = [(o.inputs[0], o.output, outputs[o.output].row_bytes) for o in plan.operations if o.kind == "pad"]
    if not pads:
        return rows
    table = rows.sparkSession.createDataFrame(pads, "source string, target string, width int")  # a row a tensor
    met = rows.join(F.broadcast(table), rows["tensor"] == F.col("source"), "left")
    zeros = F.unhex(F.repeat(F.lit("00"), F.col("width") - F.octet_length("raw")))
    return met.select(F.coalesce("target", "tensor").alias("tensor"), "row_id", F.when(F.col("width").isNull(), F.col("raw")).otherwise(F.concat("raw", zeros)).alias("raw"))


def permuted_rows(rows: DataFrame, plan: Plan, perm: DataFrame) -> DataFrame:
    names = [o.output for o in plan.operations if o.kind == "permute"]
    kept = rows.where(~F.col("tensor").isin(names)) if names else rows
    return kept.unionByName(permute_rows(rows.where(F.col("tensor").isin(names)), perm, "row_id")) if names else kept


EXECUTORS = (Executor("identity", copied_rows), Executor(TOKEN, lambda rows, plan, perm: permuted_rows(rows, plan, perm), needs_secret=True), Executor("expand-test", lambda rows, plan, perm: padded_rows(rows, plan)))


class Engine:
    """Architectures and executors besides its own are given by name, or registered later."""

    def __init__(self, spark: SparkSession, architectures: tuple[Architecture, ...] = (), executors: tuple[Executor, ...] = ()) -> None:
        self.spark = spark
        self.architectures = Architectures(LLAMA, *architectures)
        self.executors = Executors(*EXECUTORS, *executors)

    def inventory(self, path: str) -> DataFrame:
        return inventory(self.spark, open_artifact(path))

    def inspect(self, path: str) -> DataFrame:
        """One row: architecture, tensors, bytes, shards. Any artifact is inspected, whatever its architecture."""
        artifact = open_artifact(path)
        return inv.inspect(inventory(self.spark, artifact)).withColumn("architecture", F.lit(artifact.architecture))

    def fingerprint(self, artifact: Artifact, digests: dict[str, str] | None = None) -> str:
        """A digest of config, sidecars and every tensor's content; how tensors are dealt to shards has no part in it."""
        digests = tensor_digests(self.spark, artifact) if digests is None else digests
        h = Blake3()

        def labelled(label: str, data: bytes) -> None:
            for part in (label.encode(), data):
                h.update(len(part).to_bytes(8, "little"))
                h.update(part)

        labelled("config", artifact.config_bytes)
        for name in artifact.sidecars:
            labelled(name, Path(artifact.root, name).read_bytes())
        for t in artifact.tensors:
            labelled("tensor", canonical_json([t.name, t.dtype, list(t.shape), t.byte_length]).encode())
            labelled("digest", digests[t.name].encode())
        return h.hexdigest()

    def plan(self, path: str, method: str = "identity", **options) -> Plan:
        artifact = open_artifact(path)
        return make_plan(artifact, method, self.fingerprint(artifact), architectures=self.architectures, **options)

    def create_secret(self, path: str, secret_path: str, output: str | None = None) -> dict:
        """Draws a permutation of the model's vocabulary and stores it where nothing is yet, readable by the owner alone.

        It must not be stored within the model or the output that it is for.
        """
        artifact, place = open_artifact(path), Path(local(secret_path)).absolute()
        target = Path(local(output)).absolute() if output else None
        doc.check_secret_path(place, Path(artifact.root), *((target, _stage_of(target)) if target else ()))
        size = self.architectures.detect(artifact).dimensions(artifact)["vocab_size"]
        perm, nonce = secret_permutation(self.spark, size)
        moved = [r["obf"] for r in perm.orderBy("orig").collect()]  # the secret is a document that the driver keeps
        secret = doc.new_secret(self.fingerprint(artifact), moved, nonce)
        fd = os.open(place, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
        with os.fdopen(fd, "w") as f:
            f.write(canonical_json(secret))
            f.flush()
            os.fsync(f.fileno())
        _sync(place.resolve().parent)
        return secret

    def load_secret(self, secret_path: str) -> tuple[dict, DataFrame]:
        """A stored secret that is whole, and its permutation."""
        secret = doc.read_secret(Path(local(secret_path)))
        return secret, self.spark.createDataFrame(list(enumerate(secret["permutation"])), "orig bigint, obf bigint")

    def transform(self, path: str, output: str, method: str = "identity", secret_path: str | None = None, **options) -> dict:
        """Writes the transformed artifact to `output`, which must not be there, and verifies it before it is published.

        A run that was stopped goes on with the shards that are whole and unchanged, if its plan is the same. An output that is
        there already is accepted only as the result of the same plan, verified anew.
        """
        source, target = Path(local(path)).resolve(), Path(local(output)).absolute()
        target = target.parent.resolve() / target.name
        stage, executor = _stage_of(target), self.executors.of(method)
        if executor.needs_secret and not secret_path:
            raise InvalidPlan("a permutation needs a secret")
        doc.check_paths(source, target, stage, Path(local(secret_path)).absolute() if secret_path else None)
        artifact, perm, secret = open_artifact(path), None, None
        digests = tensor_digests(self.spark, artifact)
        fingerprint = self.fingerprint(artifact, digests)
        if executor.needs_secret:
            secret, perm = self.load_secret(secret_path)
            if secret["source_fingerprint"] != fingerprint:
                raise InvalidPlan("the secret is for another artifact")
        plan = make_plan(artifact, method, fingerprint, secret_id=secret and secret["secret_id"], architectures=self.architectures, **options)
        executor.accept(plan, secret)
        if secret is not None:
            if secret["vocab_size"] != plan.logical["vocab_size"]:
                raise InvalidPlan("the secret is for another vocabulary")
            _check_tied(artifact, digests)
        if target.exists():
            manifest = target / MANIFEST
            stored = strict_json(manifest.read_bytes(), MANIFEST) if manifest.is_file() else {}
            if not doc.same_result(stored, plan):
                raise AlreadyExists(str(target))
            self.verify(str(target))
            return stored
        with _locked(target):
            stage.mkdir(parents=True, exist_ok=True)
            written = self._write(artifact, plan, executor, perm, stage)
            self._guard(artifact, plan, digests, written)
            sidecars = {n: blake3(Path(stage, n).read_bytes()).hexdigest() for n in artifact.sidecars}
            manifest = doc.manifest_of(plan, blake3(artifact.config_bytes).hexdigest(), sidecars, written)
            (stage / CHECKPOINT).unlink(missing_ok=True)
            _store(stage / MANIFEST, canonical_json(manifest))
            self.verify(str(stage))
            _rename_new(stage, target)
            _sync(target.parent)
        return strict_json(canonical_json(manifest), MANIFEST)

    @staticmethod
    def _prepare(artifact: Artifact, plan: Plan, stage: Path) -> None:
        """Config and sidecars in the stage: what is there already must be the same to the byte."""
        for name, data in [(CONFIG, artifact.config_bytes), *((n, Path(artifact.root, n).read_bytes()) for n in artifact.sidecars)]:
            file = stage / name
            if not file.exists():
                file.write_bytes(data)
            elif file.read_bytes() != data:
                raise ResumeMismatch(f"{name} of the unfinished output is another")
        known = {s.filename for s in plan.shards} | {CONFIG, CHECKPOINT, INDEX, MANIFEST, *artifact.sidecars}
        if stray := [p.name for p in stage.iterdir() if p.name not in known and not p.name.endswith(".part")]:
            raise ResumeMismatch(f"files of no plan: {stray}")

    def _write(self, artifact: Artifact, plan: Plan, executor: Executor, perm: DataFrame | None, stage: Path) -> dict[str, str]:
        """Writes what the stage lacks; gives every output tensor's digest."""
        state = stage / CHECKPOINT
        if state.is_file():
            stored = strict_json(state.read_bytes(), CHECKPOINT)
            doc.check_checkpoint(stored, plan)
        elif any(stage.iterdir()):
            raise ResumeMismatch("the unfinished output has no checkpoint")
        else:
            stored = doc.contract(plan) | {"shards": {}}
            _store(state, canonical_json(stored))
        self._prepare(artifact, plan, stage)
        done = [s for s in plan.shards if s.filename in stored["shards"]]
        for shard in done:
            file = stage / shard.filename
            if not file.is_file() or file.stat().st_size != len(shard.header) + shard.payload:
                raise OutputCorrupted(f"{shard.filename} is not as it was written")
            with file.open("rb") as f:
                if f.read(len(shard.header)) != shard.header:
                    raise OutputCorrupted(f"{shard.filename} has another header")
        digests = shard_digests(self.spark, done, stage)
        for shard in done:
            if wrong := [n for n, d in stored["shards"][shard.filename].items() if digests.get(n) != d]:
                raise OutputCorrupted(f"{wrong[0]} in {shard.filename} is not as it was written")
        missing = [s for s in plan.shards if s.filename not in stored["shards"]]
        made_from = {o.output: o.inputs[0] for o in plan.operations}
        wave = max(1, self.spark.sparkContext.defaultParallelism)
        for i in range(0, len(missing), wave):  # a job writes a wave of shards; each wave is a point to go on from
            shards = missing[i : i + wave]
            rows = read_rows(self.spark, artifact.root, [made_from[t.name] for s in shards for t in s.tensors])
            part = write_rows(executor.run(rows, plan, perm), shards, str(stage)).collect()  # a row a tensor
            for shard in shards:
                stored["shards"][shard.filename] = {r["tensor"]: r["digest"] for r in part if r["filename"] == shard.filename}
                digests |= stored["shards"][shard.filename]
            _store(state, canonical_json(stored))
        if index := index_of(plan.shards):
            (stage / INDEX).write_text(index, encoding="utf-8")
        return digests

    def _guard(self, artifact: Artifact, plan: Plan, before: dict[str, str], written: dict[str, str]) -> None:
        """The source must be as it was when it was planned, and a permutation must not leave the embedding as it was."""
        for o in plan.operations:
            if o.kind == "copy" and written[o.output] != before[o.inputs[0]]:
                raise InvalidTensor(f"{o.inputs[0]} changed while it was read")
            if o.kind == "permute" and o.output != HEAD and written[o.output] == before[o.inputs[0]]:
                raise InvalidPlan(f"{o.output} is the same after the permutation")
        others = [o.inputs[0] for o in plan.operations if o.kind != "copy"]
        again = tensor_digests(self.spark, artifact, others) if others else {}
        if changed := [n for n, d in again.items() if d != before[n]]:
            raise InvalidTensor(f"{changed[0]} changed while it was read")

    def verify(self, path: str) -> dict:
        """Checks a published artifact against its manifest, by reading every byte; one without is checked as a container."""
        artifact = open_artifact(path)
        root = Path(artifact.root)
        digests = tensor_digests(self.spark, artifact)
        report = {"tensors": len(artifact.tensors), "payload_bytes": sum(t.byte_length for t in artifact.tensors), "fingerprint": self.fingerprint(artifact, digests)}
        file = root / MANIFEST
        if not file.is_file():
            return {"scope": "container"} | report
        manifest = strict_json(file.read_bytes(), MANIFEST)
        plan = doc.check_manifest(manifest)
        sizes = {name: (root / name).stat().st_size for name in {t.shard for t in artifact.tensors} | {s["filename"] for s in manifest.get("layout") or [] if (root / s["filename"]).is_file()}}
        doc.check_artifact(artifact, manifest, plan, digests, sizes)
        if plan is None:
            return {"scope": "legacy"} | report
        doc.check_index((root / INDEX).read_text(encoding="utf-8") if (root / INDEX).is_file() else None, plan.shards)
        return {"scope": "current", "plan_hash": manifest["plan_hash"], "standard": manifest["standard"]} | report


def _stage_of(target: Path) -> Path:
    return target.with_name(f".{target.name}{WORK}")


def _check_tied(artifact: Artifact, digests: dict[str, str]) -> None:
    """A head that the config ties to the embedding must be the same, if it is there: only then may both be permuted as one."""
    head, embedding = artifact.tensor(HEAD), artifact.tensor(EMBEDDING)
    if artifact.config.get("tie_word_embeddings") is True and head and embedding:
        if (head.dtype, head.shape) != (embedding.dtype, embedding.shape) or digests[HEAD] != digests[EMBEDDING]:
            raise InvalidTensor(f"{HEAD} is tied to the embedding and differs from it")

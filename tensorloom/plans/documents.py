"""The documents that the engine keeps: secrets, checkpoints and manifests, and what each must agree with."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable
from pathlib import Path

import numpy as np

from tensorloom.errors import InvalidArtifact, InvalidPlan, InvalidTensor, OutputCorrupted, ResumeMismatch, Unsupported, UnsupportedVersion
from tensorloom.functions.blake3 import blake3
from tensorloom.plans.plan import METHODS, VERSION, Plan, layout_hash, plan_from
from tensorloom.sources.safetensors import INDEX, SINGLE, Artifact, Shard, Tensor, canonical_json, encode_header, strict_json

MANIFEST, CHECKPOINT = "tensorloom.json", "checkpoint.json"
SECRET_VERSION, SECRET_LIMIT = 1, 64 << 20
TOKEN = "token-permutation"
_HEX = re.compile("[0-9a-f]{64}")
_SECRET = {"version", "method", "source_fingerprint", "vocab_size", "nonce", "permutation", "inverse", "secret_id"}


def method_of(name: str) -> dict[str, str]:
    return {"id": name, "version": METHODS[name]}


def commitment(secret: dict) -> str:
    """The secret's id: a BLAKE3 digest that binds all that it holds."""
    h = blake3(b"tensorloom secret\0" + struct.pack("<I", secret["version"]))
    for part in (secret["method"]["id"], secret["method"]["version"]):
        h.update(struct.pack("<I", len(part.encode())) + part.encode())
    h.update(bytes.fromhex(secret["source_fingerprint"]) + struct.pack("<Q", secret["vocab_size"]) + bytes.fromhex(secret["nonce"]))
    for numbers in (secret["permutation"], secret["inverse"]):
        h.update(np.array(numbers, "<u4").tobytes())
    return h.hexdigest()


def new_secret(fingerprint: str, moved: list[int], nonce: str) -> dict:
    inverse = np.empty(len(moved), np.int64)
    inverse[moved] = np.arange(len(moved))
    secret = {"version": SECRET_VERSION, "method": method_of(TOKEN), "source_fingerprint": fingerprint, "vocab_size": len(moved), "nonce": nonce, "permutation": moved, "inverse": inverse.tolist()}
    return secret | {"secret_id": commitment(secret)}


def check_secret(secret: object) -> None:
    """Every rule of a secret by itself."""
    if not isinstance(secret, dict) or secret.keys() != _SECRET:
        raise InvalidPlan("a secret lacks fields, or has others")
    if secret["version"] != SECRET_VERSION or type(secret["version"]) is not int:
        raise UnsupportedVersion(str(secret["version"]))
    if secret["method"] != method_of(TOKEN):
        raise Unsupported("a secret of another method")
    size = secret["vocab_size"]
    if type(size) is not int or not 2 <= size < 1 << 32:
        raise InvalidPlan(f"a vocabulary of {size}")
    for name in ("source_fingerprint", "nonce", "secret_id"):
        if not isinstance(secret[name], str) or not _HEX.fullmatch(secret[name]):
            raise InvalidPlan(f"{name} is not 64 lower-case hexadecimal digits")
    for name in ("permutation", "inverse"):
        if not isinstance(secret[name], list) or len(secret[name]) != size or not all(type(x) is int and 0 <= x < size for x in secret[name]):
            raise InvalidPlan(f"{name} is not of the vocabulary")
    moved, back = np.array(secret["permutation"]), np.array(secret["inverse"])
    if len(np.unique(moved)) != size:
        raise InvalidPlan("the secret is no permutation")
    if (moved == np.arange(size)).all():
        raise InvalidPlan("the permutation moves nothing")
    if (moved[back] != np.arange(size)).any():
        raise InvalidPlan("the stored inverse is another permutation's")
    if commitment(secret) != secret["secret_id"]:
        raise InvalidPlan("the secret doesn't match its own id")


def read_secret(path: Path) -> dict:
    if path.is_symlink():
        raise InvalidPlan("the secret is a link")
    if path.stat().st_size > SECRET_LIMIT:
        raise InvalidPlan("a secret of more than 64 MiB")
    secret = strict_json(path.read_bytes(), str(path))
    check_secret(secret)
    return secret


def check_paths(source: Path, target: Path, stage: Path, secret: Path | None) -> None:
    """Input and output apart, and the secret in neither, nor where the output is made."""
    if source == target or source in target.parents or target in source.parents:
        raise InvalidPlan("input and output are within each other")
    if secret is not None:
        check_secret_path(secret, source, target, stage)


def check_secret_path(secret: Path, *folders: Path) -> None:
    if secret.is_symlink():
        raise InvalidPlan("the secret is a link")
    place = secret.parent.resolve() / secret.name
    for folder in folders:
        if place == folder or folder in place.parents:
            raise InvalidPlan(f"the secret is within {folder}")


def contract(plan: Plan) -> dict:
    """What a checkpoint must share with the plan that goes on from it."""
    return {
        "version": plan.version,
        "source_fingerprint": plan.fingerprint,
        "plan_hash": plan.hash,
        "layout_hash": layout_hash(plan.layout()),
        "method": method_of(plan.method),
        "secret_key_id": None,
        "secret_id": plan.secret_id,
        "runtime": plan.runtime(),
    }


def check_checkpoint(stored: dict, plan: Plan) -> None:
    if stored.get("version") != VERSION:
        raise UnsupportedVersion(str(stored.get("version")))
    if stored.get("runtime") is None:
        raise ResumeMismatch("a checkpoint without a runtime contract")
    if other := [k for k, v in contract(plan).items() if stored.get(k) != v]:
        raise ResumeMismatch(f"the unfinished output is another plan's: {', '.join(other)}")
    if strange := stored.get("shards", {}).keys() - {s.filename for s in plan.shards}:
        raise ResumeMismatch(f"shards of no plan: {sorted(strange)}")


def manifest_of(plan: Plan, config_digest: str, sidecars: dict[str, str], digests: dict[str, str]) -> dict:
    """The outer fields repeat the embedded plan's; check_manifest holds them to it."""
    out = {
        "artifact_version": VERSION,
        "method": method_of(plan.method),
        "architecture": plan.architecture,
        "source_fingerprint": plan.fingerprint,
        "plan_hash": plan.hash,
        "layout_hash": layout_hash(plan.layout()),
        "runtime": plan.runtime(),
        "standard": plan.runtime()["standard"],
        "layout": plan.layout(),
        "plan": plan.document(),
        "config_digest": config_digest,
        "sidecars": sidecars,
        "tensors": [{"name": t.name, "dtype": t.dtype, "shape": list(t.shape), "byte_length": t.byte_length, "digest": digests[t.name]} for t in plan.output],
        "secret_key_id": None,
    }
    return out if plan.secret_id is None else out | {"secret_id": plan.secret_id}


def check_layout(layout: list[dict]) -> None:
    """A layout by itself: dense ids, names, tensors one after another, and files as long as header and payload."""
    if not layout:
        raise InvalidArtifact("a layout without shards")
    names = [SINGLE] if len(layout) == 1 else [f"model-{i + 1:05d}-of-{len(layout):05d}.safetensors" for i in range(len(layout))]
    seen: set[str] = set()
    for i, (shard, name) in enumerate(zip(layout, names, strict=True)):
        if shard["id"] != i or shard["filename"] != name:
            raise InvalidArtifact(f"shard {i} is {shard['id']}, {shard['filename']}")
        at = 0
        for t in shard["tensors"]:
            tensor = Tensor(t["name"], t["dtype"], tuple(t["shape"]))
            if t["offset"] != at or t["byte_length"] != tensor.byte_length or t["name"] in seen:
                raise InvalidArtifact(f"{t['name']}: its place is not its own")
            seen.add(t["name"])
            at += t["byte_length"]
        header = encode_header([Tensor(t["name"], t["dtype"], tuple(t["shape"])) for t in shard["tensors"]])
        if shard["payload"] != at or shard["file_length"] != len(header) + at:
            raise InvalidArtifact(f"{name}: its lengths are not its tensors'")


def check_manifest(manifest: dict) -> Plan | None:
    """The rules of a manifest by itself; gives its plan, or None of the older versions, which have none."""
    version = manifest.get("artifact_version")
    if version in (1, 2):
        _check_older(manifest, version)
        return None
    if version != VERSION:
        raise UnsupportedVersion(str(version))
    for name in ("plan", "runtime", "layout_hash", "layout"):
        if manifest.get(name) is None:
            raise InvalidArtifact(f"a manifest without its {name}")
    try:
        plan = plan_from(manifest["plan"])
        plan.validate()
        check_layout(manifest["layout"])
    except (KeyError, TypeError, ValueError, InvalidPlan, InvalidTensor) as error:
        raise InvalidArtifact(f"the plan within the manifest is not valid: {error}") from error
    wanted = {
        "artifact_version": plan.version,
        "method": method_of(plan.method),
        "architecture": plan.architecture,
        "source_fingerprint": plan.fingerprint,
        "plan_hash": plan.hash,
        "layout": plan.layout(),
        "secret_id": plan.secret_id,
        "runtime": plan.runtime(),
        "standard": plan.runtime()["standard"],
        "layout_hash": layout_hash(plan.layout()),
    }
    wrong = [k for k, v in wanted.items() if manifest.get(k) != v]
    if wrong or layout_hash(manifest["layout"]) != manifest["layout_hash"] or canonical_json(plan.document()) != canonical_json(manifest["plan"]):
        raise InvalidArtifact(f"the manifest is not its plan's: {', '.join(wrong) or 'plan'}")
    return plan


def _check_older(manifest: dict, version: int) -> None:
    if any(manifest.get(name) is not None for name in ("plan", "runtime", "layout_hash")):
        raise InvalidArtifact("an older manifest with fields of a newer one")
    method, secret = manifest.get("method"), manifest.get("secret_id")
    whole = method == method_of("identity") and secret is None if version == 1 else method == method_of(TOKEN) and isinstance(secret, str) and bool(_HEX.fullmatch(secret))
    if not whole or manifest.get("standard") is not True:
        raise InvalidArtifact("method, version and secret of an older manifest don't agree")


def same_result(manifest: dict, plan: Plan) -> bool:
    """Whether what is published is the result of a plan."""
    fields = contract(plan)
    return manifest.get("artifact_version") == plan.version and all(manifest.get(k) == v for k, v in fields.items() if k != "version")


def check_artifact(artifact: Artifact, manifest: dict, plan: Plan | None, digests: dict[str, str], sizes: dict[str, int]) -> None:
    """What is in a folder against its manifest: config, sidecars, tensors, dimensions, and every shard's size and places."""
    if blake3(artifact.config_bytes).hexdigest() != manifest["config_digest"]:
        raise OutputCorrupted("the config is another")
    sidecars = {n: blake3(Path(artifact.root, n).read_bytes()).hexdigest() for n in artifact.sidecars}
    if sidecars != manifest["sidecars"]:
        raise OutputCorrupted(f"sidecars differ: {sorted(k for k in sidecars.keys() | manifest['sidecars'].keys() if sidecars.get(k) != manifest['sidecars'].get(k))}")
    listed = {t["name"]: t for t in manifest["tensors"]}
    if len(listed) != len(manifest["tensors"]) or listed.keys() != {t.name for t in artifact.tensors}:
        raise OutputCorrupted("tensors are missing, added or listed twice")
    for t in artifact.tensors:
        entry = listed[t.name]
        if (t.dtype, list(t.shape), t.byte_length, digests[t.name]) != (entry["dtype"], entry["shape"], entry["byte_length"], entry["digest"]):
            raise OutputCorrupted(t.name)
    if plan is None:
        return
    for name, value in plan.logical.items():
        if name in artifact.config and artifact.config[name] != value:
            raise OutputCorrupted(f"{name} is {artifact.config[name]}, of {value} in the plan")
    padded = {o.output for o in plan.operations if o.kind == "pad"}
    if wrong := [t.name for t in plan.output if t.name in padded and t.shape[1] != plan.physical.get("hidden_size")]:
        raise OutputCorrupted(f"{wrong[0]} has not the physical hidden size")
    if {t.name for t in plan.output} != listed.keys():
        raise OutputCorrupted("the plan's tensors are not the manifest's")
    layout = {s["filename"]: s for s in manifest["layout"]}
    if sizes.keys() != layout.keys():
        raise OutputCorrupted(f"shards that are missing or of no plan: {sorted(sizes.keys() ^ layout.keys())}")
    places = {t["name"]: (s, t["offset"]) for s in layout.values() for t in s["tensors"]}
    for name, size in sizes.items():
        if size != layout[name]["file_length"]:
            raise OutputCorrupted(f"{name} has {size} bytes")
    for t in artifact.tensors:
        shard, offset = places[t.name]
        if t.shard != shard["filename"] or t.offset != shard["file_length"] - shard["payload"] + offset:
            raise OutputCorrupted(f"{t.name} is at another place")


def check_binding(secret: dict, source_config: dict, config: dict, manifest: dict) -> None:
    """Whether a permuted model may be used with a secret by a client that loads it as a standard model."""
    if source_config != config:
        raise InvalidPlan("the configs differ")
    if config.get("vocab_size") != secret["vocab_size"]:
        raise InvalidPlan("the secret is for another vocabulary")
    version = manifest.get("artifact_version")
    if version not in (2, VERSION):
        raise UnsupportedVersion(str(version))
    if manifest.get("method") != method_of(TOKEN):
        raise InvalidPlan("the model is not a permuted one")
    if version == VERSION:
        runtime, plan = manifest.get("runtime"), manifest.get("plan")
        if not isinstance(runtime, dict) or not isinstance(plan, dict):
            raise InvalidPlan("a manifest without its runtime or its plan")
        if runtime.get("id") != "huggingface" or runtime.get("standard") is not True or manifest.get("standard") is not True:
            raise InvalidPlan("the model is not for a standard runtime")
        if plan.get("method") != manifest["method"] or plan.get("source_fingerprint") != manifest.get("source_fingerprint") or plan_from(plan).hash != manifest.get("plan_hash"):
            raise InvalidPlan("the manifest is not its plan's")
    for name in ("secret_id", "source_fingerprint"):
        if manifest.get(name) != secret[name]:
            raise InvalidPlan(f"{name} is not the secret's")


def check_index(text: str | None, shards: Iterable[Shard]) -> None:
    """A stored index against the shards that it is of; one shard alone has none."""
    shards = list(shards)
    if (text is None) != (len(shards) == 1):
        raise InvalidArtifact(f"{INDEX} where it doesn't belong, or none")
    if text is not None:
        index = strict_json(text, INDEX)
        if index.get("weight_map") != {t.name: s.filename for s in shards for t in s.tensors}:
            raise InvalidArtifact(f"{INDEX} has another map")
        if index.get("metadata", {}).get("total_size") != sum(s.payload for s in shards):
            raise InvalidArtifact(f"{INDEX} has another total")

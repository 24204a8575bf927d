"""Plans: what a transform will do with every tensor, as a document that can be hashed, stored and checked."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, field

from tensorloom.errors import InvalidPlan, MemoryLimitExceeded, Unsupported, UnsupportedVersion
from tensorloom.functions.blake3 import blake3
from tensorloom.operators.inventory import CHUNK, TENSOR_BYTES, TOKEN_BYTES
from tensorloom.plans.registry import LLAMA, Architectures, natural
from tensorloom.sources.safetensors import Artifact, Shard, Tensor, canonical_json, plan_shards

VERSION = 3
METHODS = {"identity": "0.1", "token-permutation": "0.1", "expand-test": "0.1"}


def layout_hash(layout: list[dict]) -> str:
    return blake3(canonical_json(layout).encode()).hexdigest()


@dataclass(frozen=True)
class Operation:
    id: int
    kind: str  # copy, permute or pad
    inputs: tuple[str, ...]
    output: str
    extra_columns: int = 0


@dataclass
class Plan:
    method: str
    architecture: str
    fingerprint: str
    source: list[Tensor]
    output: list[Tensor]
    operations: list[Operation]
    shards: list[Shard]
    memory_limit: int
    peak_bytes: int
    secret_id: str | None = None
    logical: dict[str, int] = field(default_factory=dict)
    physical: dict[str, int] = field(default_factory=dict)
    expansion: int | None = None
    version: int = VERSION
    workers: int = 1
    dtype: str = "preserve"

    def layout(self) -> list[dict]:
        """Every shard with the places of its tensors, offsets being from the end of the header."""
        out = []
        for i, s in enumerate(self.shards):
            at, tensors = 0, []
            for t in s.tensors:
                tensors.append({"name": t.name, "dtype": t.dtype, "shape": list(t.shape), "offset": at, "byte_length": t.byte_length})
                at += t.byte_length
            out.append({"id": i, "filename": s.filename, "payload": at, "file_length": len(s.header) + at, "tensors": tensors})
        return out

    def runtime(self) -> dict:
        standard = self.expansion is None
        out = {"id": "huggingface" if standard else "padded", "standard": standard, "logical": self.logical, "physical": self.physical}
        return out if standard else out | {"expansion": self.expansion}

    def summary(self) -> dict:
        return {
            "version": self.version,
            "method": {"id": self.method, "version": METHODS[self.method]},
            "secret_id": self.secret_id,
            "architecture": self.architecture,
            "runtime": self.runtime(),
            "source_fingerprint": self.fingerprint,
            "plan_hash": self.hash,
            "source_tensor_count": len(self.source),
            "output_tensor_count": len(self.output),
            "operations": len(self.operations),
            "source_payload_bytes": sum(t.byte_length for t in self.source),
            "output_payload_bytes": sum(t.byte_length for t in self.output),
            "shards": [{"id": s["id"], "filename": s["filename"], "payload_bytes": s["payload"], "file_bytes": s["file_length"]} for s in self.layout()],
            "memory": {"limit": self.memory_limit, "peak": self.peak_bytes},
        }

    def document(self) -> dict:
        strip = lambda t: {k: v for k, v in asdict(t).items() if k not in ("shard", "offset")}
        out = {
            "version": self.version,
            "method": {"id": self.method, "version": METHODS[self.method]},
            "architecture": self.architecture,
            "source_fingerprint": self.fingerprint,
            "source": [asdict(t) for t in self.source],
            "output": [strip(t) for t in self.output],
            "operations": [asdict(o) for o in self.operations],
            "layout": self.layout(),
            "memory": {"limit": self.memory_limit, "peak": self.peak_bytes},
            "runtime": self.runtime(),
            "workers": self.workers,
            "dtype": self.dtype,
        }
        if self.secret_id is not None:
            out["secret_id"] = self.secret_id
        return out

    @property
    def hash(self) -> str:
        return hashlib.sha256(canonical_json(self.document()).encode()).hexdigest()

    def validate(self) -> None:
        """The rules of a plan's graph and method; the same on tables are in operators.checks."""
        if self.version != VERSION:
            raise UnsupportedVersion(str(self.version))
        if self.workers != 1 or self.dtype != "preserve":
            raise Unsupported(f"{self.workers} workers, dtype {self.dtype}")
        sources, outputs = {t.name: t for t in self.source}, {t.name: t for t in self.output}
        made: set[str] = set()
        if len({o.id for o in self.operations}) < len(self.operations):
            raise InvalidPlan("an operation's id is used twice")
        for o in self.operations:
            if not o.inputs or len(set(o.inputs)) < len(o.inputs):
                raise InvalidPlan(f"operation {o.id}: no inputs, or one twice")
            if missing := [i for i in o.inputs if i not in sources]:
                raise InvalidPlan(f"operation {o.id}: unknown inputs {missing}")
            if o.output not in outputs or o.output in made:
                raise InvalidPlan(f"operation {o.id}: {o.output} is unknown or made twice")
            made.add(o.output)
            a, b = sources[o.inputs[0]], outputs[o.output]
            if o.kind in ("copy", "permute"):
                if (a.name, a.dtype, a.shape) != (b.name, b.dtype, b.shape):
                    raise InvalidPlan(f"operation {o.id} must keep name, shape and dtype")
                if o.kind == "permute" and self.method != "token-permutation":
                    raise InvalidPlan("a permutation without its method")
            elif self.method != "expand-test" or o.extra_columns != 2 * (self.expansion or 0) or a.dtype != b.dtype or b.shape != (*a.shape[:1], *(x + o.extra_columns for x in a.shape[1:])):
                raise InvalidPlan(f"operation {o.id}: padding that its method doesn't allow")
        if made != outputs.keys():
            raise InvalidPlan("an output has no producer")
        if (self.method == "token-permutation") != (self.secret_id is not None):
            raise InvalidPlan("method and secret don't agree")
        if self.method != "expand-test" and (self.logical != self.physical or self.expansion is not None):
            raise InvalidPlan("a standard method keeps the dimensions")
        if self.method == "expand-test" and (not self.expansion or self.physical.get("hidden_size") != self.logical.get("hidden_size", 0) + 2 * self.expansion):
            raise InvalidPlan("the physical hidden size is not the padded one")
        if sorted(t.name for s in self.shards for t in s.tensors) != sorted(outputs):
            raise InvalidPlan("the layout is not of the outputs")


def plan_from(document: dict) -> Plan:
    """The plan that a document is of."""
    tensor = lambda d: Tensor(d["name"], d["dtype"], tuple(d["shape"]), d.get("shard", ""), d.get("offset", 0))
    method, runtime = document["method"], document["runtime"]
    if METHODS.get(method["id"]) != method["version"]:
        raise InvalidPlan(f"method {method['id']} {method['version']}")
    return Plan(
        method["id"],
        document["architecture"],
        document["source_fingerprint"],
        [tensor(t) for t in document["source"]],
        [tensor(t) for t in document["output"]],
        [Operation(o["id"], o["kind"], tuple(o["inputs"]), o["output"], o["extra_columns"]) for o in document["operations"]],
        [Shard(s["filename"], tuple(Tensor(t["name"], t["dtype"], tuple(t["shape"])) for t in s["tensors"])) for s in document["layout"]],
        document["memory"]["limit"],
        document["memory"]["peak"],
        document.get("secret_id"),
        runtime["logical"],
        runtime["physical"],
        runtime.get("expansion"),
        document["version"],
        document["workers"],
        document["dtype"],
    )


def make_plan(artifact: Artifact, method: str, fingerprint: str, memory_limit: int = 256 << 20, max_shard: int = 4 << 30, secret_id: str | None = None, expansion: int | None = None, architectures: Architectures | None = None) -> Plan:
    """The plan of a method on an artifact: one operation a tensor, in order of names."""
    if method not in METHODS:
        raise Unsupported(method)
    if max_shard <= 0:
        raise InvalidPlan("the largest shard must have a size above zero")
    operations, output, logical, physical = [], [], {}, {}
    vocab, moved = 0, ()
    if method == "expand-test":
        hidden = natural(artifact.config, "hidden_size")
        if not expansion or hidden is None:
            raise InvalidPlan("padding needs an expansion and a hidden size")
        logical, physical = {"hidden_size": hidden}, {"hidden_size": hidden + 2 * expansion}
    else:
        kind = (architectures or Architectures(LLAMA)).detect(artifact)
        dims = kind.dimensions(artifact)
        kind.check_schema(artifact, dims)
        logical = physical = dims
        if method == "token-permutation":
            vocab = dims["vocab_size"]
            if vocab < 2:
                raise InvalidPlan("a vocabulary of fewer than two rows")
            kind.check_vocabulary(artifact, vocab)
            moved = kind.vocabulary
    for i, t in enumerate(artifact.tensors):
        kind, extra, target = "copy", 0, Tensor(t.name, t.dtype, t.shape)
        if t.name in moved:
            kind = "permute"
        elif method == "expand-test" and len(t.shape) == 2 and t.shape[1] == logical["hidden_size"]:
            kind, extra = "pad", 2 * expansion
            name = t.name.removesuffix(".source.weight") + ".target.weight" if t.name.endswith(".source.weight") else t.name
            target = Tensor(name, t.dtype, (t.shape[0], t.shape[1] + extra))
        operations.append(Operation(i, kind, (t.name,), target.name, extra))
        output.append(target)
    metadata = TENSOR_BYTES * (len(artifact.tensors) + len(output)) + TOKEN_BYTES * vocab
    if memory_limit <= metadata:
        raise MemoryLimitExceeded(f"{metadata} bytes for the plan alone, of {memory_limit}")
    peak = metadata + min(memory_limit - metadata, CHUNK)
    plan = Plan(method, artifact.architecture, fingerprint, artifact.tensors, output, operations, plan_shards(output, max_shard), memory_limit, peak, secret_id, logical, physical, expansion)
    plan.validate()
    return plan



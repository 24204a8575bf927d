"""What the engine can be extended by: architectures that it knows, and executors of operations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tensorloom.errors import AlreadyExists, AmbiguousArchitecture, InvalidPlan, Unsupported, UnsupportedArchitecture
from tensorloom.operators.checks import LAYER, REQUIRED, VOCABULARY_DTYPES, WHOLE
from tensorloom.sources.safetensors import EMBEDDING, HEAD, Artifact


def natural(config: dict, name: str) -> int | None:
    value = config.get(name)
    return value if type(value) is int and 0 <= value < 1 << 64 else None


@dataclass(frozen=True)
class Architecture:
    """matches(config) says whether a model is of this kind; the others check a model and raise what keeps it from being supported."""

    name: str
    matches: Callable[[dict], bool]
    dimensions: Callable[[Artifact], dict[str, int]]
    check_schema: Callable[[Artifact, dict[str, int]], None]
    check_vocabulary: Callable[[Artifact, int], None]
    vocabulary: tuple[str, ...]  # tensors whose rows are tokens


class Architectures:
    def __init__(self, *known: Architecture) -> None:
        self.known: dict[str, Architecture] = {}
        for one in known:
            self.register(one)

    def register(self, one: Architecture) -> None:
        if one.name in self.known:
            raise AlreadyExists(f"architecture {one.name}")
        self.known[one.name] = one

    def detect(self, artifact: Artifact) -> Architecture:
        """The only architecture that a model is of."""
        found = [one for one in self.known.values() if one.matches(artifact.config)]
        if not found:
            raise UnsupportedArchitecture(artifact.architecture)
        if len(found) > 1:
            raise AmbiguousArchitecture(", ".join(sorted(one.name for one in found)))
        return found[0]


def _dimensions(artifact: Artifact) -> dict[str, int]:
    dims = {}
    for name in REQUIRED:
        value = natural(artifact.config, name)
        if value is None:
            raise UnsupportedArchitecture(f"no {name}")
        dims[name] = value
    heads, hidden = dims["num_attention_heads"], dims["hidden_size"]
    kv = natural(artifact.config, "num_key_value_heads")
    kv = heads if kv is None else kv
    if not heads or not kv or kv > heads or hidden % heads:
        raise UnsupportedArchitecture(f"{heads} heads, {kv} key-value heads and a hidden size of {hidden}")
    head = natural(artifact.config, "head_dim")
    head = hidden // heads if head is None else head
    if heads * head != hidden:
        raise UnsupportedArchitecture(f"{heads} heads of {head} for a hidden size of {hidden}")
    return dims | {"num_key_value_heads": kv, "head_dim": head}


def _check_schema(artifact: Artifact, dims: dict[str, int]) -> None:
    sizes = {"hidden": dims["hidden_size"], "inner": dims["intermediate_size"], "kv": dims["num_key_value_heads"] * dims["head_dim"], "vocab": dims["vocab_size"]}
    wanted = {f"model.layers.{i}.{name}": shape for i in range(dims["num_hidden_layers"]) for name, shape in LAYER.items()} | WHOLE
    for name, shape in wanted.items():
        t = artifact.tensor(name)
        if t is None:
            if name in artifact.aliases:
                continue
            raise UnsupportedArchitecture(f"no tensor {name}")
        if t.shape != tuple(sizes[s] for s in shape):
            raise UnsupportedArchitecture(f"{name} has the shape {list(t.shape)}")


def _check_vocabulary(artifact: Artifact, vocab: int) -> None:
    """What a vocabulary must be like to be permuted."""
    if artifact.tensor("lm_head.bias"):
        raise Unsupported("a head with a bias")
    for name in (EMBEDDING, HEAD):
        t = artifact.tensor(name) if name == HEAD else artifact.required(name)
        if t and (t.dtype not in VOCABULARY_DTYPES or t.shape[:1] != (vocab,)):
            raise Unsupported(f"{name}: {t.dtype} {list(t.shape)}")
        if t:
            t.matrix_row_bytes()


LLAMA = Architecture("llama", lambda config: config.get("model_type") == "llama", _dimensions, _check_schema, _check_vocabulary, (EMBEDDING, HEAD))


@dataclass(frozen=True)
class Executor:
    """Carries out the operations of one method: run(rows, plan, perm) gives the rows (tensor, row_id, raw) of the outputs."""

    method: str
    run: Callable[[DataFrame, object, DataFrame | None], DataFrame]
    needs_secret: bool = False

    def accept(self, plan, secret: dict | None) -> None:
        """Refuses a plan that is another method's, or whose secret is not the one at hand."""
        if plan.method != self.method:
            raise InvalidPlan(f"a plan of {plan.method} for the executor of {self.method}")
        if plan.workers != 1 or plan.dtype != "preserve":
            raise Unsupported(f"{plan.workers} workers, dtype {plan.dtype}")
        if self.needs_secret != (secret is not None) or (secret and secret["secret_id"] != plan.secret_id):
            raise InvalidPlan("the plan is bound to another secret")
        if secret and secret["source_fingerprint"] != plan.fingerprint:
            raise InvalidPlan("the secret is for another artifact")


class Executors:
    def __init__(self, *known: Executor) -> None:
        self.known: dict[str, Executor] = {}
        for one in known:
            self.register(one)

    def register(self, one: Executor) -> None:
        if one.method in self.known:
            raise AlreadyExists(f"executor of {one.method}")
        self.known[one.method] = one

    def of(self, method: str) -> Executor:
        if method not in self.known:
            raise Unsupported(f"no executor of {method}")
        return self.known[method]

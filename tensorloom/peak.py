"""python -m tensorloom.peak [MiB ...]: how much memory the workers of an identity transform take, by the payload's size.

For each size a model is made and transformed by a process of its own on one core. What counts is the most that any Python
worker had at once: rows are read, written and hashed there, in pieces of bounded size, so the peaks must not grow with
the payload. The Java heap is bounded by its own setting. The last line has the spread of the peaks, which passes up to 16 MiB.
"""

from __future__ import annotations

import json
import subprocess
import sys
import tempfile
import threading
import time
from pathlib import Path

from tensorloom.operators.checks import LAYER
from tensorloom.sources import safetensors as st

SPREAD_MIB = 16
SIZES = (128, 512)
_RUN = """
import sys
from pyspark.sql import SparkSession
from tensorloom.plans.engine import Engine
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
Engine(spark).transform(sys.argv[1], sys.argv[2], max_shard=32 << 20)
"""


def make_model(folder: Path, mib: int, tensors: int = 16) -> None:
    """A small model with `tensors` more tensors that make up the payload."""
    folder.mkdir(parents=True)
    dims = {"hidden": 2, "inner": 2, "kv": 2, "vocab": 3}
    names = {f"model.layers.0.{n}": s for n, s in LAYER.items()} | {st.EMBEDDING: ("vocab", "hidden"), "model.norm.weight": ("hidden",)}
    some = [st.Tensor(n, "F32", tuple(dims[d] for d in s)) for n, s in sorted(names.items())]
    rows = (mib << 20) // tensors // 4096
    some += [st.Tensor(f"payload.{i:02d}", "U8", (rows, 4096)) for i in range(tensors)]
    config = {"model_type": "llama", "hidden_size": 2, "intermediate_size": 2, "num_attention_heads": 1, "num_hidden_layers": 1, "vocab_size": 3, "tie_word_embeddings": True}
    (folder / st.CONFIG).write_text(json.dumps(config))
    with (folder / st.SINGLE).open("wb") as f:
        f.write(st.encode_header(some))
        for t in some:
            left = t.byte_length
            while left:
                n = min(left, 1 << 20)
                f.write(bytes(range(256)) * (n // 256) + bytes(n % 256))
                left -= n


def _descendants(pid: int) -> list[int]:
    children: dict[int, list[int]] = {}
    for stat in Path("/proc").glob("[0-9]*/stat"):
        try:
            fields = stat.read_text().rsplit(")", 1)[1].split()
        except OSError:
            continue
        children.setdefault(int(fields[1]), []).append(int(stat.parent.name))
    out, queue = [], [pid]
    while queue:
        queue += (found := children.get(queue.pop(), []))
        out += found
    return out


def _watch(pid: int, peak: dict[int, int], stop: threading.Event) -> None:
    while not stop.is_set():
        for child in _descendants(pid):
            try:
                if "python" not in Path(f"/proc/{child}/comm").read_text():
                    continue
                lines = Path(f"/proc/{child}/status").read_text().splitlines()
            except OSError:
                continue
            high = next((int(x.split()[1]) for x in lines if x.startswith("VmHWM")), 0)
            peak[child] = max(peak.get(child, 0), high)
        time.sleep(0.05)


def peak_mib(mib: int, folder: Path) -> float:
    """The largest worker's peak, in MiB, while a model of that payload is transformed."""
    source = folder / f"m{mib}"
    make_model(source, mib)
    process = subprocess.Popen([sys.executable, "-c", _RUN, str(source), str(folder / f"o{mib}")], cwd=Path(__file__).resolve().parent.parent, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    peak: dict[int, int] = {}
    stop = threading.Event()
    watcher = threading.Thread(target=_watch, args=(process.pid, peak, stop))
    watcher.start()
    code = process.wait()
    stop.set()
    watcher.join()
    if code:
        raise RuntimeError(f"the transform of {mib} MiB failed")
    return max(peak.values(), default=0) / 1024


def main(argv: list[str] | None = None) -> int:
    sizes = [int(x) for x in (sys.argv[1:] if argv is None else argv)] or list(SIZES)
    with tempfile.TemporaryDirectory(prefix="peak-") as folder:
        peaks = {n: round(peak_mib(n, Path(folder)), 1) for n in sizes}
    spread = round(max(peaks.values()) - min(peaks.values()), 1)
    print(json.dumps({"peak_mib": peaks, "spread_mib": spread, "passes": spread <= SPREAD_MIB}))
    return 0 if spread <= SPREAD_MIB else 1


if __name__ == "__main__":
    sys.exit(main())

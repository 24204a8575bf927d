"""python -m tensorloom inspect | plan | transform | verify: the engine from the command line, reports as JSON."""

from __future__ import annotations

import argparse
import json
import re
import sys

from pyspark.sql import SparkSession

from tensorloom.errors import EngineError, Unsupported
from tensorloom.functions.scalars import UNITS
from tensorloom.plans.engine import Engine


def size(text: str) -> int:
    """Bytes of a size such as 4GiB, 100 KB or 12."""
    found = re.fullmatch(r"([0-9]+) *(GiB|MiB|KiB|GB|MB|KB|B|)", text.strip())
    if not found or (value := int(found[1]) * UNITS[found[2]]) >= 1 << 64:
        raise argparse.ArgumentTypeError(f"{text!r} is no size")
    return value


def arguments(argv: list[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="tensorloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("inspect", "verify", "plan", "transform"):
        command = commands.add_parser(name)
        command.add_argument("model")
        if name in ("plan", "transform"):
            method = command.add_mutually_exclusive_group(required=True)
            method.add_argument("--identity", dest="method", action="store_const", const="identity")
            method.add_argument("--method", choices=["identity", "token-permutation"])
            command.add_argument("--memory-limit", type=size, default=256 << 20)
            command.add_argument("--max-shard-size", type=size, default=4 << 30)
        if name == "transform":
            command.add_argument("--output", required=True)
            command.add_argument("--secret-output")
            command.add_argument("--resume", action="store_true", help="use the secret that is there")
    return top.parse_args(argv)


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    engine = Engine(spark)
    if args.command == "inspect":
        return engine.inspect(args.model).first().asDict()
    if args.command == "verify":
        return engine.verify(args.model)
    options = {"memory_limit": args.memory_limit, "max_shard": args.max_shard_size}
    token = args.method == "token-permutation"
    if args.command == "plan":
        if token:
            raise Unsupported("a plan of the permutation needs its secret: use transform")
        plan = engine.plan(args.model, args.method, **options)
        return plan.summary()
    if token != (args.secret_output is not None):
        raise Unsupported("--secret-output belongs to the permutation, which needs it")
    if token and not args.resume:
        engine.create_secret(args.model, args.secret_output, args.output)
    manifest = engine.transform(args.model, args.output, args.method, args.secret_output, **options)
    return {"plan_hash": manifest["plan_hash"], "tensors": len(manifest["tensors"])}


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    spark = SparkSession.builder.appName("tensorloom").getOrCreate()
    try:
        print(json.dumps(run(spark, args), indent=2))
    except (EngineError, OSError) as error:
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

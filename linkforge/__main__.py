"""python -m linkforge COMMAND --option value ...: runs a command and prints its report as JSON."""

from __future__ import annotations

import argparse
import inspect
import json

from pyspark.sql import SparkSession

from linkforge.plans.commands import COMMANDS


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="linkforge")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run in COMMANDS.items():
        one = commands.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        for option in list(inspect.signature(run).parameters.values())[1:]:
            needed = option.default is inspect.Parameter.empty
            one.add_argument(f"--{option.name}", required=needed, default=None if needed else option.default, type=int if option.annotation == "int" else str)
    asked = vars(parser.parse_args(argv))
    spark = SparkSession.builder.appName("linkforge").getOrCreate()
    print(json.dumps(COMMANDS[asked.pop("command")](spark, **asked), indent=1, default=str))


if __name__ == "__main__":
    main()

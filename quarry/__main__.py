"""python -m quarry: the version, and the build plan and risks as text."""

from __future__ import annotations

import argparse
import sys

from quarry.operators.capacity import plan_rows

VERSION = "0.1.0"


def table(rows: list[tuple[str, ...]]) -> str:
    """Columns padded to their widest cell, two blanks apart."""
    widths = [max(map(len, column)) for column in zip(*rows, strict=True)]
    return "\n".join("  ".join(cell.ljust(w) for cell, w in zip(row, widths, strict=True)).rstrip() for row in rows)


def plan() -> str:
    return table([("STEP", "TITLE"), *((i, title) for kind, i, title, _, _ in plan_rows() if kind == "step")])


def risks() -> str:
    return "\n".join(title + " (primary)" * primary + f": {measures} measures" for kind, _, title, primary, measures in plan_rows() if kind == "risk")


def main(args: list[str] | None = None) -> int:
    """0, or 2 for a command that isn't known."""
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__)
    parser.add_argument("--version", action="version", version=VERSION)
    parser.add_argument("command", nargs="?", default="help", choices=("version", "plan", "risks", "help"))
    try:
        command = parser.parse_args(args).command
    except SystemExit as e:
        return int(e.code or 0)
    print({"version": lambda: VERSION, "plan": plan, "risks": risks, "help": parser.format_help}[command]())
    return 0


if __name__ == "__main__":
    sys.exit(main())

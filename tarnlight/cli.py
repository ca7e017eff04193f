"""Commands: analyze-file, analyze-batch and init-config."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .plans.config import Config, ConfigError, merged, read_config, template
from .plans.pipeline import Pipeline


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tarnlight", description="Profile tables with Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("analyze-file", "file"), ("analyze-batch", "folder")):
        c = sub.add_parser(name)
        c.add_argument("path", help=f"the {what} to analyse")
        c.add_argument("--config")
        c.add_argument("--target")
        c.add_argument("--target-type", choices=("classification", "regression"))
        c.add_argument("--output-dir")
        c.add_argument("--sample-size", type=int)
        c.add_argument("--delimiter")
        c.add_argument("--encoding")
        c.add_argument("--decimal", choices=(".", ","))
        c.add_argument("--strict", action="store_true", default=None)
        c.add_argument("--verbose", action="store_true", default=None)
        if what == "file":
            c.add_argument("--sheet")
        else:
            c.add_argument("--pattern")
            c.add_argument("--recursive", action="store_true", default=None)
    c = sub.add_parser("init-config")
    c.add_argument("path", nargs="?", default="tarnlight.yaml")
    c.add_argument("--force", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    """0 if all went well, 1 if a table or step failed, 2 for wrong settings."""
    args = _parser().parse_args(argv)
    if args.command == "init-config":
        path = Path(args.path)
        if path.exists() and not args.force:
            print(f"{path} is there already; --force replaces it", file=sys.stderr)
            return 1
        path.write_text(template(), encoding="utf-8")
        return 0
    given = {"target": {"target_column": args.target, "target_type": args.target_type}, "output_dir": args.output_dir, "sample_size": args.sample_size, "delimiter": args.delimiter, "encoding": args.encoding, "decimal": args.decimal, "strict_mode": args.strict, "verbose": args.verbose}
    given |= {"input_file": args.path, "excel_sheet": args.sheet} if args.command == "analyze-file" else {"input_folder": args.path, "batch_pattern": args.pattern, "batch_recursive": args.recursive}
    try:
        config = Config.of(merged(read_config(args.config) if args.config else None, given))
    except ConfigError as error:
        print(error, file=sys.stderr)
        return 2
    try:
        results = Pipeline(config).setup().run()
    except Exception as error:
        print(f"failed: {error}", file=sys.stderr)
        return 1
    for name, r in results.items():
        print(f"{name}: " + (r["html_report"] or r["output_dir"] if r["success"] else f"failed: {r['error']}"))
    return int(not results or any(not r["success"] or r["failed_steps"] for r in results.values()))


if __name__ == "__main__":
    sys.exit(main())

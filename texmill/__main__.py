"""python -m texmill [NAME [SF_DIR [OUT]]]: lists the queries, shows a query's rows, or writes them as Parquet."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from texmill.registry import QUERIES

    if not args:
        print("\n".join(sorted(QUERIES)))
        return 0
    if args[0] not in QUERIES:
        print(f"no such query: {args[0]}", file=sys.stderr)
        return 2
    from texmill.session import local_session
    from texmill.sources.texts import write_table

    rows = QUERIES[args[0]](local_session(), args[1] if len(args) > 1 else "/root/testdata/sf0.001")
    if len(args) > 2:
        write_table(rows, args[2])
    else:
        rows.show(50, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

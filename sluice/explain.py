"""python -m sluice.explain sluice:E0015:17+1:0 [QUERY]: what a compact error says."""

from __future__ import annotations

import sys

from sluice.plans.errors import QueryError


def main(arguments: list[str]) -> int:
    error = QueryError.parse(arguments[0]) if arguments else None
    if error is None:
        print(__doc__, file=sys.stderr)
        return 2
    print(error.render(arguments[1]) if len(arguments) > 1 else f"E{error.code:04}: {error.message()}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

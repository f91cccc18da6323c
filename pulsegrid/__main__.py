"""``python -m pulsegrid list`` and ``python -m pulsegrid run QUERY FOLDER [ROWS]``."""

from __future__ import annotations

import sys

from pulsegrid.plans import catalog
from pulsegrid.session import local_session


def main(args: list[str]) -> int:
    known = catalog.queries()
    if args[:1] == ["list"]:
        print("\n".join(sorted(known)))
        return 0
    if args[:1] == ["run"] and len(args) >= 3 and args[1] in known:
        known[args[1]](local_session(), args[2]).show(int(args[3]) if len(args) > 3 else 20, truncate=False)
        return 0
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""`python -m ledgerloom.plans check|report FOLDER`: the checks of a folder of mapping files, or its coverage.

Exit codes: 0; 1 where the check finds errors; 2 for wrong arguments and folders that can't be loaded.
"""

from __future__ import annotations

import sys
import tomllib

from ledgerloom.operators.reports import check_text, coverage_markdown
from ledgerloom.plans.mapping import MappingError, compile_all

USAGE = "usage: python -m ledgerloom.plans check|report <mappings folder>\n"


def run(args: list[str]) -> tuple[str, int]:
    """The text to print, and the exit code."""
    if not args or args[0] not in ("check", "report"):
        return USAGE, 2
    if len(args) < 2:
        return f"name a folder of mapping files\n\n{USAGE}", 2
    try:
        c = compile_all(args[1])
    except (MappingError, OSError, tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        return f"error: {e}\n", 2
    if args[0] == "report":
        return coverage_markdown(c), 0
    return check_text(c), int(any(f.severity == "error" for f in c.findings))


if __name__ == "__main__":
    text, code = run(sys.argv[1:])
    sys.stdout.write(text)
    sys.exit(code)

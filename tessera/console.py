"""Results as text."""

from __future__ import annotations

from typing import TextIO

from tessera.session import Result


def write_result(out: TextIO, result: Result) -> None:
    """A box around the rows, then the message; nothing for a statement that failed.

    The rows are read twice, for the widths and for the output, so a result of
    any size passes through without being held.
    """
    if not result.success:
        return
    if result.df is None:
        if result.message:
            out.write(result.message + "\n")
        return
    rows, shown = result.rows, 0
    widths = [len(n) for n in rows.names]
    for row in rows:
        widths = [max(w, len(x)) for w, x in zip(widths, row)]
    rule = "+" + "".join("-" * (w + 2) + "+" for w in widths) + "\n"
    line = lambda row: "|" + "".join(f" {x:<{w}} |" for x, w in zip(row, widths)) + "\n"
    out.write(rule + line(rows.names) + rule)
    for row in rows:
        out.write(line(row))
        shown += 1
    out.write(f"{rule}{shown} row(s) selected\n")

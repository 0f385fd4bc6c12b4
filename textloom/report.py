"""Markdown tables and throughput reports."""

from __future__ import annotations

import textwrap


def table(rows: list[list[str]], headers: list[str] | None = None, alignments: list[str] | None = None, highlight: set[tuple[int, int]] | None = None, max_column_width: int = 48) -> str:
    """A Markdown table; long cells wrap onto further lines of their row."""
    body = [[f"**{c}**" if (i, j) in (highlight or ()) else str(c) for j, c in enumerate(r)] for i, r in enumerate(rows)]
    heads = headers or [""] * len(body[0])
    if any(len(r) != len(heads) for r in body):
        raise ValueError("all rows need as many cells as there are headers")
    align = alignments or ["left"] * len(heads)
    split = [[textwrap.wrap(c, max_column_width) or [""] for c in r] for r in [heads, *body]]
    width = [max(3, *(len(part) for r in split for part in r[j])) for j in range(len(heads))]
    put = {"left": str.ljust, "right": str.rjust, "center": str.center}
    line = lambda cells: "| " + " | ".join(put[a](c, w) for c, a, w in zip(cells, align, width)) + " |"
    rule = {"left": lambda w: ":" + "-" * (w - 1), "right": lambda w: "-" * (w - 1) + ":", "center": lambda w: ":" + "-" * (w - 2) + ":"}
    out = []
    for i, r in enumerate(split):
        for k in range(max(map(len, r))):
            out.append(line([c[k] if k < len(c) else "" for c in r]))
        if i == 0:
            out.append("| " + " | ".join(rule[a](w) for a, w in zip(align, width)) + " |")
    return "\n".join(out)


def throughput(task: str, model: str, items: int, num_bytes: int, seconds: float, **more: object) -> str:
    """One-row report: items and kilobytes a second, and whatever else is given."""
    heads = ["Task", "Model", "Input size", "Runtime in seconds", "Seq/s", "kB/s", *more]
    row = [task, model, f"{items:,} sequences, {num_bytes / 1000:,.2f} kB", f"{seconds:.1f}", f"{items / seconds:.1f}", f"{num_bytes / 1000 / seconds:.2f}", *map(str, more.values())]
    return table([row], heads, ["left"] * 2 + ["right"] * (len(heads) - 2))

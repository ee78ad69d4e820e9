"""A small runner of named steps, of which a range can be run: "A:B" (both included; a plus takes the step after too)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Steps:
    names: list[str] = field(default_factory=list)
    functions: list[Callable] = field(default_factory=list)
    always: list[bool] = field(default_factory=list)

    def step(self, name: str, always: bool = False):
        def add(f: Callable) -> Callable:
            if name in self.names:
                raise ValueError(f"{name} is there twice")
            self.names.append(name)
            self.functions.append(f)
            self.always.append(always)
            return f

        return add

    def chosen(self, ranges: str | None = None) -> list[str]:
        """Steps of comma-separated ranges, open at either end, with the steps that always run, in order."""
        if ranges is None:
            return list(self.names)
        picked: set[int] = set()
        for part in (p.strip() for p in ranges.split(",")):
            if not part:
                continue
            more = part.endswith("+")
            start, colon, end = part.rstrip("+").partition(":")
            first = self.names.index(start) if start else 0
            last = (self.names.index(end) if end else len(self.names) - 1) if colon else first
            picked |= {*range(first, min(last + more, len(self.names) - 1) + 1)}
        return [n for i, n in enumerate(self.names) if i in picked or self.always[i]]

    def run(self, context: dict, ranges: str | None = None) -> dict:
        for name in self.chosen(ranges):
            out = self.functions[self.names.index(name)](context)
            if out is not None:
                context[name] = out
        return context


def isolated(df, group: str, schema: str, f: Callable):
    """f over each group with its failure kept: rows (group, ok, error, payload json)."""
    import json
    import traceback

    import pandas as pd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf[group].iloc[0]
        try:
            return pd.DataFrame([(key, True, None, json.dumps(f(pdf)))], columns=[group, "ok", "error", "payload"])
        except Exception:  # the failure of one group is its result
            return pd.DataFrame([(key, False, traceback.format_exc(limit=1), None)], columns=[group, "ok", "error", "payload"])

    return df.groupBy(group).applyInPandas(solve, schema)

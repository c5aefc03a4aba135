"""The run's bounded tables as lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Section, table of run_system, and its columns in order.
SECTIONS = [
    ("Results", "run", ("total", "annualised", "sharpe", "vol", "max_drawdown", "trades", "win_rate", "profit_factor", "costs")),
    ("Walk-forward", "walk_forward", ("windows", "profitable", "mean", "median", "sharpe", "stitched")),
    ("False discoveries", "fdr", ()),
    ("Distance baseline", "baseline", ("total", "sharpe", "days", "pairs")),
    ("Random pairs", "random", ("total", "sharpe", "draws", "low", "high")),
]


def _show(value: object) -> str:
    return "-" if value is None else f"{value:,.4f}" if isinstance(value, float) else str(value)


def report_lines(found: dict[str, DataFrame]) -> list[str]:
    """Lines on what run_system returned: one-row tables, then profiles and tests of the returns, then strategy against baselines.

    Absent tables are passed over. Only tables of one row, a row a profile or a row a test are read.
    """
    out, totals = [], {}
    for title, name, columns in SECTIONS:
        if name not in found:
            continue
        row = found[name].first()
        got = row.asDict() if row else {}
        out.append(title)
        out += [f"  {c:<16}{_show(got.get(c))}" for c in columns or got]
        if "total" in got and "sharpe" in got:
            totals[title] = got
    if "fund_replay" in found:
        out.append("Profiles")
        out += [f"  {r.profile:<16}total {_show(r.total)}  sharpe {_show(r.sharpe)}  drawdown {_show(r.max_drawdown)}{'  stopped' if r.stopped else ''}" for r in found["fund_replay"].orderBy("profile").collect()]
    if "significance" in found:
        out.append("Significance")
        out += [f"  {r.section:<14}{r.measure:<16}{_show(r.value)}" for r in found["significance"].collect()]
    if "Results" in totals and len(totals) > 1:
        out.append("Strategy less baseline")
        out += [f"  {k:<20}total {_show((totals['Results']['total'] or 0.0) - (v['total'] or 0.0))}  sharpe {_show((totals['Results']['sharpe'] or 0.0) - (v['sharpe'] or 0.0))}" for k, v in totals.items() if k != "Results"]
    return out

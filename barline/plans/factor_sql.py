"""Factor expressions in DuckDB SQL: a second backend for the checked syntax tree, written from the functions' definitions.

Window functions don't nest, so each rolling function gets its argument as a column of one level and is itself a column of the next.
"""

from __future__ import annotations

import ast

from ..functions.factors import OPERANDS, check
from . import indicator_sql as sql

#: Functions of a column x and a window w that give the level's columns, innermost first; the last one is the result.
ROLLING = {
    "ts_mean": lambda x, w: [sql.roll("avg", x, w)],
    "ts_std": lambda x, w: [sql.roll("stddev_samp", x, w)],
    "ts_min": lambda x, w: [sql.roll("min", x, w)],
    "ts_max": lambda x, w: [sql.roll("max", x, w)],
    "ts_sum": lambda x, w: [sql.roll("sum", x, w)],
    "ts_delta": lambda x, w: [f"{x} - {sql.lag(x, w)}"],
    "pct_change": lambda x, w: [f"{x} / nullif({sql.lag(x, w)}, 0) - 1"],
    "zscore": lambda x, w: [f"({x} - ({sql.roll('avg', x, w)})) / nullif(({sql.roll('stddev_samp', x, w)}), 0)"],
    "ts_rank": lambda x, w: [f"list({x}) FILTER ({x} IS NOT NULL) {sql.over(w)}", f"CASE WHEN {x} IS NOT NULL AND len({{}}) >= {w} THEN len(list_filter({{}}, lambda v: v <= {x})) / len({{}})::DOUBLE END"],
}
PLAIN = {
    "tanh": "tanh({0})", "sign": "CAST(sign({0}) AS DOUBLE)", "absv": "abs({0})", "logv": "CASE WHEN {0} IS NOT NULL THEN ln(greatest({0}, 1e-9)) END",
    "clip": "CASE WHEN {0} IS NOT NULL THEN least(greatest({0}, {1}), {2}) END",
}
SIGNS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*"}


def factor_ctes(texts: dict[str, str], source: str = "f", out: str = "fx") -> str:
    """CTEs that add each named expression to ``source``; the last one is called ``out``."""
    levels: list[list[str]] = []

    def put(expression: str, level: int) -> str:
        while len(levels) <= level:
            levels.append([])
        name = f"e{level}_{len(levels[level])}"
        levels[level].append(f"{expression} AS {name}")
        return name

    def build(node: ast.expr) -> tuple[str, int]:
        """An expression, and the first level whose rows hold all that it names."""
        match node:
            case ast.Constant(value=v):
                return f"{float(v)!r}::DOUBLE", 0
            case ast.Name(id=n):
                return f"CAST({OPERANDS[n]} AS DOUBLE)", 0
            case ast.UnaryOp(operand=a):
                x, level = build(a)
                return f"(-{x})", level
            case ast.BinOp(left=a, op=op, right=b):
                (x, i), (y, j) = build(a), build(b)
                return f"({x} / nullif({y}, 0))" if type(op) is ast.Div else f"({x} {SIGNS[type(op)]} {y})", max(i, j)
            case ast.Call(func=ast.Name(id=f), args=[a, b]) if f in ROLLING:
                x, level = build(a)
                x = put(x, level)
                first, *more = ROLLING[f](x, b.value)
                name, level = put(first, level + 1), level + 2
                for m in more:
                    name, level = put(m.format(*[name] * m.count("{}")), level), level + 1
                return name, level
            case ast.Call(func=ast.Name(id=f), args=args):
                parts = [build(a) for a in args]
                return PLAIN[f].format(*(p for p, _ in parts)), max(i for _, i in parts)

    for name, text in texts.items():
        x, level = build(check(text))
        x = put(x, level)
        levels += [[] for _ in range(level + 2 - len(levels))]
        levels[level + 1].append(f"CASE WHEN abs({x}) < 'inf'::DOUBLE THEN {x} END AS {name}")
    before, ctes = source, []
    for k, columns in enumerate(levels):
        name = out if k == len(levels) - 1 else f"{out}_{k}"
        ctes.append(f"{name} AS (SELECT *, {', '.join(columns)} FROM {before})")
        before = name
    return ",\n".join(ctes)


def needs(texts: dict[str, str]) -> tuple[str, ...]:
    """The features that the expressions read, as names of :data:`indicator_sql.SQL`."""
    return tuple(dict.fromkeys(f for o, f in OPERANDS.items() if f in sql.SQL and any(isinstance(n, ast.Name) and n.id == o for t in texts.values() for n in ast.walk(check(t)))))

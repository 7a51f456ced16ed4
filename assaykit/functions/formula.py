"""Derived columns from arithmetic formulas.

A formula is a Python-style arithmetic expression. Column names that are not plain identifiers are
written in back quotes: "`SIO2(WT%)` / (MGO + 1)". ``mean``, ``std`` and ``var`` (population forms)
are whole-column values; they are computed in one aggregate and enter the row expression as literals,
so no window runs over the table. Division by zero and undefined powers or logarithms give NULL.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.table import c

ROW_FUNCTIONS = {"sin": 1, "cos": 1, "tan": 1, "pow": 2, "log": 1}
COLUMN_FUNCTIONS = {"mean": F.avg, "std": F.stddev_pop, "var": F.var_pop}


class FormulaError(ValueError):
    pass


def _defined(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))


class _Builder:
    def __init__(self, text: str, columns: Sequence[str], forbidden: Sequence[str] = ()):
        self.names: dict[str, str] = {}

        def placeholder(match: re.Match) -> str:
            key = f"_quoted_{len(self.names)}"
            self.names[key] = match.group(1)
            return key

        self.columns, self.forbidden = set(columns), set(forbidden)
        self.used: set[str] = set()
        try:
            self.tree = ast.parse(re.sub(r"`([^`]+)`", placeholder, text), mode="eval").body
        except SyntaxError as error:
            raise FormulaError(f"cannot read formula {text!r}") from error

    def aggregates(self) -> dict[str, Column]:
        """Whole-column parts of the formula, keyed by their text."""
        found: dict[str, Column] = {}
        for node in ast.walk(self.tree):
            if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in COLUMN_FUNCTIONS:
                if any(self._is_aggregate(inner) for arg in node.args for inner in ast.walk(arg)):
                    raise FormulaError("column functions cannot be nested")
                found[ast.unparse(node)] = COLUMN_FUNCTIONS[node.func.id](self.build(self._args(node, 1)[0], {}))
        return found

    @staticmethod
    def _is_aggregate(node: ast.AST) -> bool:
        return isinstance(node, ast.Call) and getattr(node.func, "id", None) in COLUMN_FUNCTIONS

    @staticmethod
    def _args(node: ast.Call, count: int) -> list[ast.expr]:
        if node.keywords or len(node.args) != count:
            raise FormulaError(f"{node.func.id} takes {count} value(s)")
        return node.args

    def build(self, node: ast.expr, literals: dict[str, float | None]) -> Column:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            return self._name(self.names.get(node.id, node.id), quoted=node.id in self.names)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            inner = self.build(node.operand, literals)
            return -inner if isinstance(node.op, ast.USub) else inner
        if isinstance(node, ast.BinOp):
            left, right = self.build(node.left, literals), self.build(node.right, literals)
            if isinstance(node.op, ast.Add):
                return left + right
            if isinstance(node.op, ast.Sub):
                return left - right
            if isinstance(node.op, ast.Mult):
                return left * right
            if isinstance(node.op, ast.Div):
                return F.try_divide(left, right)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            return self._call(node, literals)
        raise FormulaError(f"not allowed in a formula: {ast.unparse(node)}")

    def _call(self, node: ast.Call, literals: dict[str, float | None]) -> Column:
        name = node.func.id
        if name in COLUMN_FUNCTIONS:
            self.build(self._args(node, 1)[0], literals)
            return F.lit(literals.get(ast.unparse(node))).cast("double")
        if name not in ROW_FUNCTIONS:
            raise FormulaError(f"unknown function {name}")
        args = [self.build(a, literals) for a in self._args(node, ROW_FUNCTIONS[name])]
        if name == "pow":
            return _defined(F.pow(args[0], args[1]))
        if name == "log":
            return F.ln(args[0])
        return {"sin": F.sin, "cos": F.cos, "tan": F.tan}[name](args[0])

    def _name(self, name: str, quoted: bool) -> Column:
        if name == "pi" and not quoted and name not in self.columns:
            return F.pi()
        if name in self.forbidden:
            raise FormulaError(f"target column {name} cannot be part of a formula")
        if name not in self.columns:
            raise FormulaError(f"unknown column {name}")
        self.used.add(name)
        return c(name).cast("double")


@dataclass(frozen=True)
class FormulaModel:
    """Formulas with the whole-column values learnt from the training table."""

    formulas: dict[str, str]
    literals: dict[str, dict[str, float | None]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        for name, text in self.formulas.items():
            builder = _Builder(text, df.columns)
            df = df.withColumn(name, builder.build(builder.tree, self.literals.get(name, {})))
        return df

    def recompute(self, df: DataFrame) -> DataFrame:
        """Replay with whole-column values taken from this table instead of the training table."""
        return fit_formulas(df, self.formulas).transform(df)


def fit_formulas(df: DataFrame, formulas: dict[str, str], targets: Sequence[str] = ()) -> FormulaModel:
    """Check the formulas and learn their whole-column values; later formulas may use earlier ones."""
    literals: dict[str, dict[str, float | None]] = {}
    for name, text in formulas.items():
        if name in df.columns:
            raise FormulaError(f"column {name} exists already")
        builder = _Builder(text, df.columns, targets)
        parts = builder.aggregates()
        builder.build(builder.tree, {})
        if not builder.used:
            raise FormulaError("a formula needs at least one column")
        if parts:
            row = df.agg(*[col.alias(f"v{i}") for i, col in enumerate(parts.values())]).first()
            literals[name] = {key: row[f"v{i}"] for i, key in enumerate(parts)}
        df = df.withColumn(name, builder.build(builder.tree, literals.get(name, {})))
    return FormulaModel(dict(formulas), literals)

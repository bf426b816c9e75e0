"""Read-only SQL over registered views: one statement, known relations, a row cap, a time limit.

Spark's own parser and analyser do the checking. The statement is explained as it stands, which fails
for several statements or broken syntax and runs nothing; then it is wrapped as a subquery, which
fails for anything but a query. Only text that passes both is run.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession

# The row cap and time limit of an ad-hoc query.
MAX_ROWS = 10_000
TIMEOUT_SECONDS = 8.0

# Functions that run code outside the query; they may not be called.
CODE_FUNCTIONS = ["java_method", "reflect", "try_reflect"]

COPIED_SETTINGS = [
    "spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled",
    "spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
    "spark.sql.autoBroadcastJoinThreshold",
]

_HEAD = re.compile(r"(\s|--[^\n]*\n|/\*.*?\*/)*(SELECT|WITH)\b", re.IGNORECASE | re.DOTALL)
_CODE = re.compile(rf"\b({'|'.join(CODE_FUNCTIONS)})\s*\(", re.IGNORECASE)
_IDENTIFIER = re.compile(r"\bidentifier\s*\(", re.IGNORECASE)
# What is no plain SQL: comments, raw and other strings, quoted names.
_QUOTED = re.compile(
    r"(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<raw>\br'[^']*')|(?P<string>'(?:[^'\\]|\\.|'')*')"
    r"|(?P<name>`(?:[^`]|``)*`|\"(?:[^\"\\]|\\.|\"\")*\")",
    re.IGNORECASE | re.DOTALL,
)
_RELATION = re.compile(r"UnresolvedRelation \[([^\]]*)\]")
_CTE = re.compile(r"^[ :+\-]*'?CTE \[([^\]]*)\]", re.MULTILINE)
_CONDITION = re.compile(r"\[([A-Z][A-Z_.]+)\]")
_SCRIPT = re.compile(r"^[ :+\-]*'?ScriptTransformation\b", re.MULTILINE)


class GovernedQueryError(ValueError):
    """The statement is not allowed, or not valid."""


@dataclass(frozen=True)
class QueryResult:
    """Rows of one ad-hoc query; ``truncated`` says that the cap cut more rows off."""

    columns: list[tuple[str, str]] = field(default_factory=list)
    rows: list[dict[str, Any]] = field(default_factory=list)
    truncated: bool = False
    error: str | None = None

    @property
    def row_count(self) -> int:
        return len(self.rows)


class GovernedSession:
    """A session of its own that knows only the views registered with it."""

    def __init__(self, spark: SparkSession) -> None:
        self.session = spark.newSession()
        for key in COPIED_SETTINGS:
            value = spark.conf.get(key, None)
            if value is not None:
                self.session.conf.set(key, value)
        self.session.conf.set("spark.sql.runSQLOnFiles", "false")
        # The check reads plans, so their lists must be printed whole.
        self.session.conf.set("spark.sql.debug.maxToStringFields", str(2**31 - 1))
        self.session.conf.set("spark.sql.maxPlanStringLength", str(2**31 - 1 - 15))
        self.session.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
        self.views: set[str] = set()

    def register(self, view: str, load: Callable[[SparkSession], DataFrame]) -> None:
        """Make the frame that ``load`` reads in this session known under a name."""
        load(self.session).createOrReplaceTempView(view)
        self.views.add(view.lower())

    def check(self, sql: str) -> str:
        """The statement without its closing semicolon, or an error saying why it may not run."""
        text = sql.strip().removesuffix(";").rstrip()
        if not text:
            raise GovernedQueryError("the statement is empty")
        if not _HEAD.match(text):
            raise GovernedQueryError("only SELECT and WITH queries may run")
        bare = _QUOTED.sub(_unquoted, text)
        if _CODE.search(bare):
            raise GovernedQueryError("functions that call other code may not run")
        if _IDENTIFIER.search(bare):
            # It names a relation by an expression, which no list of names can be held against.
            raise GovernedQueryError("names may not be computed")
        try:
            # Brackets in texts and quoted names could pass for a relation in the printed plan.
            told = _QUOTED.sub(lambda m: m[0].replace("[", "("), text)
            plan = self.session.sql(f"EXPLAIN EXTENDED {told}").first()[0]
        except ParseException as problem:
            raise GovernedQueryError(f"not a single valid statement: {_short(problem)}") from problem
        parsed, analysed, _ = plan.partition("== Analyzed Logical Plan ==")
        if not analysed:
            reason = _CONDITION.search(plan)
            raise GovernedQueryError(f"cannot be planned: {reason[1] if reason else 'unknown'}")
        if _SCRIPT.search(parsed):
            raise GovernedQueryError("script transforms may not run")
        self._check_relations(parsed)
        return text

    def _check_relations(self, parsed: str) -> None:
        named = {name.strip().lower() for found in _CTE.findall(parsed) for name in found.split(",")}
        used = {name.strip().lower() for name in _RELATION.findall(parsed)}
        unknown = used - self.views - named
        # A name that is a subquery in one place could be a stored table in another.
        unknown |= {n for n in used & named - self.views if self.session.catalog.tableExists(n)}
        if unknown:
            raise GovernedQueryError(f"not registered: {', '.join(sorted(unknown)[:5])}")
        if self.views and not used & self.views:
            raise GovernedQueryError("the query reads no registered view")

    def frame(self, sql: str, max_rows: int | None = None) -> DataFrame:
        """The checked query as a lazy frame, for results that stay on the cluster."""
        text = self.check(sql)
        try:
            # Line breaks keep a trailing comment from swallowing the bracket.
            df = self.session.sql(f"SELECT * FROM (\n{text}\n) AS governed")
        except AnalysisException as problem:
            raise GovernedQueryError(_short(problem)) from problem
        return df if max_rows is None else df.limit(max_rows)

    def execute(
        self, sql: str, max_rows: int | None = None, timeout: float = TIMEOUT_SECONDS
    ) -> QueryResult:
        """Run an ad-hoc query under the row cap and the time limit; problems come as ``error``."""
        cap = min(max_rows or MAX_ROWS, MAX_ROWS)
        context = self.session.sparkContext
        tag = f"governed-{uuid.uuid4().hex}"
        late = threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(timeout, stop)
        context.addJobTag(tag)
        timer.start()
        try:
            df = self.frame(sql)
            fetched = df.limit(cap + 1).collect()
        except GovernedQueryError as problem:
            return QueryResult(error=str(problem))
        except Exception as problem:  # a cancelled job surfaces as a gateway error
            if late.is_set():
                return QueryResult(error="the query took too long")
            if isinstance(problem, PySparkException):
                return QueryResult(error=_short(problem))
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)
        return QueryResult(
            columns=list(df.dtypes),
            rows=[row.asDict() for row in fetched[:cap]],
            truncated=len(fetched) > cap,
        )


def _unquoted(match: re.Match) -> str:
    """A comment as a blank, a string as an empty one, a quoted name as its letters."""
    if match["comment"]:
        return " "
    return match["name"][1:-1] if match["name"] else "''"


def _short(problem: PySparkException) -> str:
    condition = problem.getCondition()
    return condition or str(problem).strip().splitlines()[0]

"""Migration SQL: splitting a file into statements, and running them on the engine's tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxmill.config import Env
from fluxmill.schemas import SPECS
from fluxmill.streaming.storage import AppendTable, SnapshotTable, Table, open_table

_LEXEME = re.compile(
    r"""
      (?P<quoted> '(?:[^']|'')*(?:'|\Z) | "(?:[^"]|"")*(?:"|\Z) | `(?:[^`]|``)*(?:`|\Z) )
    | (?P<comment> --[^\n]* | /\*.*?(?:\*/|\Z) )
    | (?P<other> . )
    """,
    re.S | re.X,
)


def lexemes(sql: str) -> Iterator[tuple[str, str]]:
    """(kind, text): quoted strings whole, comments whole, anything else a character at a time."""
    return ((m.lastgroup, m[0]) for m in _LEXEME.finditer(sql))


def split_at(sql: str, mark: str) -> list[str]:
    """Parts between marks that stand outside quotes, comments and parentheses; comments go."""
    parts, depth = [""], 0
    for kind, text in lexemes(sql):
        if kind == "comment":
            continue
        if kind == "other":
            depth += (text == "(") - (text == ")")
            if text == mark and (depth <= 0 or mark == ";"):
                parts.append("")
                continue
        parts[-1] += text
    return parts


def split_statements(sql: str) -> list[str]:
    """The file's statements: parted at semicolons outside quotes and comments, comments dropped."""
    return [s for s in map(str.strip, split_at(sql, ";")) if s]


def render(sql: str, values: Mapping[str, object]) -> str:
    """Put in the values of ${names}; unknown names stay."""
    return re.sub(r"\$\{(\w+)\}", lambda m: str(values.get(m[1], m[0])), sql)


def _body(sql: str) -> tuple[str, str]:
    """The first parenthesis' content, and what follows it."""
    depth, inside, after, state = 0, [], [], 0
    for _, text in lexemes(sql):
        if state == 2:
            after.append(text)
            continue
        depth += (text == "(") - (text == ")")
        if state == 1 and depth == 0:
            state = 2
        elif state == 1:
            inside.append(text)
        elif depth == 1:
            state = 1
    return "".join(inside), "".join(after)


def _columns(text: str) -> T.StructType:
    """Column definitions as Spark reads them, NOT NULL and comments included."""
    return T.StructType.fromDDL(" ".join(text.split("\n")))


class Executor:
    """Runs one statement; table names may be qualified by this environment's catalog and schema."""

    def __init__(self, spark: SparkSession, env: Env):
        self.spark, self.env = spark, env

    def name(self, text: str) -> str:
        parts = text.replace("`", "").split(".")
        if parts[:-1] not in ([], [self.env.schema], [self.env.catalog, self.env.schema]):
            raise ValueError(f"{text} isn't in {self.env.catalog}.{self.env.schema}")
        return parts[-1]

    def table(self, text: str) -> Table:
        return open_table(self.spark, self.env.table_path(self.name(text)))

    def execute(self, sql: str) -> DataFrame | None:
        for pattern, act in self._FORMS:
            if m := re.match(pattern, sql, re.I | re.S):
                return act(self, m)
        return self.query(sql)

    def query(self, sql: str) -> DataFrame:
        """Any other SQL, over the environment's tables as views."""
        session = self.spark
        for name in list_tables(session, self.env):
            if re.search(rf"\b{re.escape(name)}\b", sql):
                read_table(session, self.env, name).createOrReplaceTempView(name)
        return session.sql(sql.replace(f"{self.env.catalog}.{self.env.schema}.", ""))

    def _create(self, m: re.Match) -> None:
        name = self.name(m["name"])
        columns, tail = _body(m["rest"])
        comment = re.search(r"\bCOMMENT\s+'((?:[^']|'')*)'", tail, re.I)
        clustered = re.search(r"\b(?:CLUSTER|PARTITIONED)\s+BY\s*\(([^)]*)\)", tail, re.I)
        cluster = [c.strip(" `\n\t") for c in clustered[1].split(",")] if clustered else []
        given = re.search(r"\bTBLPROPERTIES\s*\(([^)]*)\)", tail, re.I)
        properties = dict(re.findall(r"'([^']*)'\s*=\s*'([^']*)'", given[1])) if given else {}
        spec = SPECS.get(name)
        schema = _columns(columns)
        keys = spec.keys if spec else tuple(f.name for f in schema if not f.nullable)
        # raw and clean rows only ever arrive; keyed state is kept in snapshots
        kind = AppendTable if not keys or name in ("silver_pings", "silver_pings_quarantine") else SnapshotTable
        if not m["guard"] and kind(self.spark, self.env.table_path(name)).exists():
            raise ValueError(f"table {name} already exists")
        kind.create(self.spark, self.env.table_path(name), schema, keys, comment=(comment[1] if comment else "").replace("''", "'"), cluster=cluster, properties=properties)

    def _add(self, m: re.Match) -> None:
        text = m["rest"].strip()
        self.table(m["name"]).add_columns(_columns(_body(text)[0] if text.startswith("(") else text))

    def _drop(self, m: re.Match) -> None:
        self.table(m["name"]).drop_columns([c.strip(" `\n\t") for c in m["rest"].strip(" ()\n").split(",")])

    def _rename(self, m: re.Match) -> None:
        self.table(m["name"]).rename_column(m["old"], m["new"])

    def _update(self, m: re.Match) -> None:
        sets, where = _where(m["rest"])
        changes = {c.strip(" `\n\t"): F.expr(e) for c, _, e in (a.partition("=") for a in split_at(sets, ","))}
        self.table(m["name"]).update(changes, F.expr(where) if where else F.lit(True))

    def _delete(self, m: re.Match) -> None:
        self.table(m["name"]).delete(F.expr(m["where"]) if m["where"] else F.lit(True))

    def _insert(self, m: re.Match) -> None:
        rows, table = self.query(m["rest"]), self.table(m["name"])
        if isinstance(table, AppendTable):
            table.append(rows.toDF(*table.columns[: len(rows.columns)]))
        else:
            table.insert(rows)

    _T = r"(?P<name>[\w`.]+)\s*"
    _FORMS = [
        (r"CREATE\s+TABLE\s+(?P<guard>IF\s+NOT\s+EXISTS\s+)?" + _T + r"(?P<rest>\(.*)", _create),
        (r"ALTER\s+TABLE\s+" + _T + r"ADD\s+COLUMNS?\s*(?P<rest>.*)", _add),
        (r"ALTER\s+TABLE\s+" + _T + r"DROP\s+COLUMNS?\s*(?P<rest>.*)", _drop),
        (r"ALTER\s+TABLE\s+" + _T + r"RENAME\s+COLUMN\s+(?P<old>\w+)\s+TO\s+(?P<new>\w+)\s*", _rename),
        (r"UPDATE\s+" + _T + r"SET\s+(?P<rest>.*)", _update),
        (r"DELETE\s+FROM\s+" + _T + r"(?:WHERE\s+(?P<where>.*))?\Z", _delete),
        (r"INSERT\s+INTO\s+(?:TABLE\s+)?" + _T + r"(?P<rest>SELECT\b.*)", _insert),
    ]


def _where(text: str) -> tuple[str, str | None]:
    """What stands before and after a WHERE outside quotes and parentheses."""
    depth, before = 0, ""
    pieces = [t for k, t in lexemes(text) if k != "comment"]
    for at, piece in enumerate(pieces):
        depth += (piece == "(") - (piece == ")")
        if depth == 0 and re.match(r"\s", piece) and re.match(r"where\s", "".join(pieces[at + 1 : at + 7]), re.I):
            return before, "".join(pieces[at + 6 :])
        before += piece
    return before, None


def list_tables(spark: SparkSession, env: Env) -> list[str]:
    from fluxmill.streaming.files import Files

    return Files(spark, env.home).names(f"{env.home}/tables")


def read_table(spark: SparkSession, env: Env, name: str) -> DataFrame:
    """A table's current rows."""
    return open_table(spark, env.table_path(name)).read()


def columns_view(spark: SparkSession, env: Env) -> DataFrame:
    """Catalog introspection: one row for each column of each table."""
    rows = [(env.schema, n, f.name, k, f.dataType.simpleString(), f.nullable, f.metadata.get("comment")) for n in list_tables(spark, env) for k, f in enumerate(open_table(spark, env.table_path(n)).schema, 1)]
    return spark.createDataFrame(rows, "table_schema STRING, table_name STRING, column_name STRING, ordinal_position INT, data_type STRING, is_nullable BOOLEAN, comment STRING")

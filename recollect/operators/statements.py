"""The statement language: SQL over the store's tables, graph patterns, and changes of memories."""
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a statement may begin with, and the clauses that may follow.
KINDS = ("SELECT", "WITH", "MATCH", "CREATE MEMORY", "UPDATE MEMORIES", "DELETE FROM MEMORIES", "SHOW TABLES", "EXPLAIN")
CLAUSES = ("FROM", "WHERE", "GROUP BY", "HAVING", "ORDER BY", "LIMIT", "OFFSET", "JOIN", "RETURN", "SET", "VALUES")
#: Most steps of a path of variable length.
STEPS = 8
_NODE = re.compile(r"\(\s*(\w*)\s*(?:\{\s*key\s*:\s*'([^']*)'\s*\})?\s*\)")
_EDGE = re.compile(r"(<?-)\s*\[\s*(\w*)\s*(?::\s*(\w+))?\s*(?:\*\s*(\d+)\s*\.\.\s*(\d+))?\s*\]\s*(->?)")
_TAIL = re.compile(r"(?is)^\s*(?:WHERE\s+(?P<where>.*?)\s+)?RETURN\s+(?P<rest>.*)$")
_CREATE = re.compile(r"(?is)^CREATE\s+MEMORY\s+'((?:[^']|'')*)'\s+(?:VALUE\s+)?'((?:[^']|'')*)'\s*$")
_UPDATE = re.compile(r"(?is)^UPDATE\s+MEMORIES\s+SET\s+(.*?)\s+WHERE\s+(.*)$")
_DELETE = re.compile(r"(?is)^DELETE\s+FROM\s+MEMORIES\s+WHERE\s+(.*)$")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def match_sql(text: str) -> str:
    """Spark SQL of MATCH (a)-[r:TYPE]->(b {key: 'x'})-[:TYPE*1..3]-(c) [WHERE ..] RETURN ..: joins over edges(src, dst, rel_type, ..).

    a.key is a node's key; r.strength and the like are an edge's columns, of edges of one step. A path of variable length
    goes along edges of one type, in up to STEPS steps, and gives each end once.
    """
    rest = text.strip()[len("MATCH"):].strip()
    nodes, joins, names, conditions = [], [], {}, []

    def node() -> None:
        nonlocal rest
        if not (m := _NODE.match(rest)):
            raise ValueError(f"a node was expected at: {rest[:40]}")
        nodes.append((m[1], m[2]))
        rest = rest[m.end():].lstrip()

    node()
    while m := _EDGE.match(rest):
        joins.append(m.groups())
        rest = rest[m.end():].lstrip()
        node()
    if not joins:
        raise ValueError("a pattern has at least one edge")
    tail = _TAIL.match(rest)
    if not tail:
        raise ValueError("RETURN is missing")
    source, ends = [], [None]
    for i, (left, name, rel, low, high, right) in enumerate(joins):
        if left == "<-" and right == "->":
            raise ValueError("an edge has one direction")
        typed = f" WHERE rel_type = {_quoted(rel)}" if rel else ""
        there, back = f"SELECT src AS f, dst AS t, * FROM edges{typed}", f"SELECT dst AS f, src AS t, * FROM edges{typed}"
        step = back if left == "<-" else there if right == "->" else f"{there} UNION ALL {back}"
        if low:
            lo, hi = int(low), int(high)
            if not 1 <= lo <= hi <= STEPS:
                raise ValueError(f"a path has 1 to {STEPS} steps")
            one = f"(SELECT DISTINCT f, t FROM ({step}))"
            paths = []
            for n in range(lo, hi + 1):
                chain = f"{one} s1" + "".join(f" JOIN {one} s{k} ON s{k - 1}.t = s{k}.f" for k in range(2, n + 1))
                paths.append(f"SELECT s1.f, s{n}.t FROM {chain}")
            step = " UNION ".join(paths)
        on = f" ON e{i}.f = e{i - 1}.t" if i else ""
        source.append(f"{'JOIN ' if i else ''}({step}) e{i}{on}")
        ends.append(f"e{i}.t")
        if name:
            names[name] = f"e{i}"
    ends[0] = "e0.f"
    for (name, key), end in zip(nodes, ends, strict=True):
        if name:
            if f"{name}.key" in names:  # a node named twice is one
                conditions.append(f"{names[f'{name}.key']} = {end}")
            names[f"{name}.key"] = end
        if key is not None:
            conditions.append(f"{end} = {_quoted(key)}")

    def put(part: str) -> str:
        # names outside of quoted strings
        pieces = re.split(r"('(?:[^']|'')*')", part)
        for k in range(0, len(pieces), 2):
            pieces[k] = re.sub(r"\b(\w+)\.(\w+)\b", lambda m: names.get(m[0]) or (f"{names[m[1]]}.{m[2]}" if m[1] in names else m[0]), pieces[k])
        return "".join(pieces)

    if tail["where"]:
        conditions.append(f"({put(tail['where'])})")
    where = f" WHERE {' AND '.join(conditions)}" if conditions else ""
    returned, *after = re.split(r"(?is)\b(ORDER\s+BY|LIMIT)\b", tail["rest"], maxsplit=1)
    return f"SELECT {put(returned.strip())} FROM {' '.join(source)}{where} {' '.join(map(put, after))}".strip()


class Statements:
    """Executes statements over named tables; a change of memories replaces the table `memories` by a new one."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self.tables = spark, dict(tables)

    def _views(self) -> None:
        for name, table in self.tables.items():
            table.createOrReplaceTempView(name)

    def kind(self, text: str) -> str:
        words = " ".join(text.upper().split())
        found = next((k for k in KINDS if words.startswith(k)), None)
        if found is None:
            raise ValueError(f"a statement begins with one of {', '.join(KINDS)}")
        return found

    def to_sql(self, text: str) -> str:
        """The Spark SQL of a statement that reads."""
        return match_sql(text) if self.kind(text) == "MATCH" else text

    def execute(self, text: str) -> DataFrame:
        """The rows of a statement; of a change, the number of memories that it changed."""
        kind, text = self.kind(text), text.strip().rstrip(";")
        self._views()
        if kind == "EXPLAIN":
            return self.explain(text[len("EXPLAIN"):])
        if kind == "SHOW TABLES":
            return self.spark.createDataFrame([(n, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.schema)) for n, t in sorted(self.tables.items())], "name string, columns string")
        if kind in ("SELECT", "WITH", "MATCH"):
            return self.spark.sql(self.to_sql(text))
        m = self.tables["memories"]
        if kind == "CREATE MEMORY":
            if not (found := _CREATE.match(text)):
                raise ValueError("CREATE MEMORY 'key' VALUE 'text'")
            key, value = (x.replace("''", "'") for x in found.groups())
            row = self.spark.createDataFrame([(key, value)], "key string, value string")
            self.tables["memories"] = m.filter(F.col("key") != key).unionByName(row, allowMissingColumns=True)
            return self.spark.createDataFrame([(1,)], "changed long")
        found = (_UPDATE if kind == "UPDATE MEMORIES" else _DELETE).match(text)
        if not found:
            raise ValueError(f"{kind} needs WHERE" + (" and SET column = value, .." if kind.startswith("UPDATE") else ""))
        hit = F.coalesce(F.expr(found.groups()[-1]), F.lit(False))
        changed = m.agg(F.count_if(hit).alias("changed"))
        if kind == "UPDATE MEMORIES":
            sets = dict(re.match(r"(?s)\s*(\w+)\s*=\s*(.*)", part).groups() for part in re.split(r",(?=(?:[^']*'[^']*')*[^']*$)(?=\s*\w+\s*=)", found[1]))
            self.tables["memories"] = m.select(*(F.when(hit, F.expr(sets[c])).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in m.columns))
        else:
            self.tables["memories"] = m.filter(~hit)
        return changed

    def explain(self, text: str) -> DataFrame:
        """line, text of the physical plan; nothing is run."""
        self._views()
        plan = self.spark.sql(f"EXPLAIN FORMATTED {self.to_sql(text)}").first()[0]
        return self.spark.createDataFrame(list(enumerate(plan.splitlines(), 1)), "line int, text string")

    def validate(self, text: str) -> tuple[bool, str | None]:
        """Whether a statement parses, and if not, why."""
        try:
            kind = self.kind(text)
            if kind in ("SELECT", "WITH", "MATCH"):
                self.spark._jsparkSession.sessionState().sqlParser().parsePlan(self.to_sql(text))
            elif kind == "EXPLAIN":
                return self.validate(text.strip()[len("EXPLAIN"):])
            elif kind != "SHOW TABLES" and not {"CREATE MEMORY": _CREATE, "UPDATE MEMORIES": _UPDATE, "DELETE FROM MEMORIES": _DELETE}[kind].match(text.strip().rstrip(";")):
                return False, f"malformed {kind}"
        except Exception as e:  # noqa: BLE001 the parser's errors come from the JVM
            return False, str(e).strip().splitlines()[0]
        return True, None

    def complete(self, prefix: str) -> list[str]:
        """Words that may go on from the last one: statements, clauses, tables and their columns."""
        last = re.split(r"[\s,(.]+", prefix)[-1].lower()
        words = [*KINDS, *CLAUSES, *self.tables, *(c for t in self.tables.values() for c in t.columns)]
        return sorted({w for w in words if last and w.lower().startswith(last)})


def format_table(df: DataFrame, rows: int = 20, width: int = 40) -> str:
    """The first rows as a text table; long values are cut."""
    head = df.limit(rows).collect()
    cut = lambda v: (s if len(s := "" if v is None else str(v)) <= width else s[: width - 1] + "…")
    cells = [[cut(c) for c in df.columns], *([cut(v) for v in r] for r in head)]
    sizes = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    line = "+" + "+".join("-" * (n + 2) for n in sizes) + "+"
    body = ["|" + "|".join(f" {v:<{n}} " for v, n in zip(r, sizes, strict=True)) + "|" for r in cells]
    return "\n".join([line, body[0], line, *body[1:], line])

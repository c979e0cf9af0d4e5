"""The MATCH/RETURN language, compiled to DataFrames.

query   := MATCH pattern {, pattern} {OPTIONAL MATCH pattern} [AT TIME instant] [WHERE expr]
           {WITH items [WHERE expr]} RETURN [DISTINCT] items [SINCE instant] [GROUP BY names]
           [HAVING expr] [ORDER BY expr [ASC|DESC] {, ...}] [LIMIT n]
instant := sums of now(), today(), timestamp("...") and interval(n, days | hours | minutes | seconds)
pattern := node {edge node};  node := (v[:Type] [{k: literal, ...}])
edge    := -[[r][:TYPE]]-> | <-[[r][:TYPE]]- | -[[r][:TYPE]]-
Input that is left over is a syntax error, a missing property is NULL, and ordering
and limits apply after filters and aggregates.  Non-aggregate items group implicitly.
AT TIME reads every entity's last state at an instant, SINCE all its states from one on;
both need an engine with a history.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo
from ..operators import store

TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<word>[A-Za-z_]\w*)|(?P<op><=|>=|<>|!=|->|<-|[-+*/=<>(){}\[\],.:%]))", re.S)
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "COLLECT"}
BUILT_IN = {"id": "entity_id", "type": "entity_type", "event_time": "ts"}
UNITS = {"DAY": 86_400, "HOUR": 3_600, "MINUTE": 60, "SECOND": 1}


class QuerySyntaxError(ValueError):
    pass


@dataclass
class Node:
    var: str
    kind: str | None = None
    props: dict = field(default_factory=dict)


@dataclass
class Edge:
    kind: str | None
    direction: str  # out, in, any
    var: str | None = None


@dataclass
class Query:
    patterns: list
    optional: list
    where: tuple | None
    stages: list
    items: list
    distinct: bool
    group: list | None
    having: tuple | None
    order: list
    limit: int | None
    at: tuple | None = None
    since: tuple | None = None


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip().rstrip(";").rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise QuerySyntaxError(f"unexpected input at {at}: {text[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.i, self.fresh = 0, 0

    def peek(self, *words: str, ahead: int = 0) -> bool:
        i = self.i + ahead
        return i < len(self.tokens) and self.tokens[i][0] in ("word", "op") and self.tokens[i][1].upper() in words

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.i += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            got = self.tokens[self.i][1] if self.i < len(self.tokens) else "end of input"
            raise QuerySyntaxError(f"expected {word}, got {got!r}")

    def name(self) -> str:
        if self.i < len(self.tokens) and self.tokens[self.i][0] == "word":
            self.i += 1
            return self.tokens[self.i - 1][1]
        raise QuerySyntaxError("expected a name")

    def query(self) -> Query:
        self.need("MATCH")
        patterns, optional = [self.pattern()], []
        while self.take(","):
            patterns.append(self.pattern())
        while self.take("OPTIONAL"):
            self.need("MATCH")
            optional.append(self.pattern())
        at = since = None
        if self.take("AT"):
            self.need("TIME")
            at = self.add()
        where = self.expr() if self.take("WHERE") else None
        stages = []
        while self.take("WITH"):
            items = self.items()
            stages.append((items, self.expr() if self.take("WHERE") else None))
        self.need("RETURN")
        distinct = self.take("DISTINCT")
        items = self.items()
        group = having = limit = None
        order = []
        if self.take("SINCE"):
            since = self.add()
        if self.take("GROUP"):
            self.need("BY")
            group = [self.expr()]
            while self.take(","):
                group.append(self.expr())
        if self.take("HAVING"):
            having = self.expr()
        if self.take("ORDER"):
            self.need("BY")
            while True:
                e = self.expr()
                order.append((e, self.take("DESC") or (self.take("ASC") and False)))
                if not self.take(","):
                    break
        if self.take("LIMIT"):
            kind, value = self.tokens[self.i] if self.i < len(self.tokens) else ("", "")
            if kind != "num" or "." in value:
                raise QuerySyntaxError("LIMIT needs a whole number")
            self.i += 1
            limit = int(value)
        if self.i < len(self.tokens):
            raise QuerySyntaxError(f"unexpected {self.tokens[self.i][1]!r}")
        return Query(patterns, optional, where, stages, items, distinct, group, having, order, limit, at, since)

    def pattern(self) -> list:
        out: list = [self.node()]
        while self.peek("-", "<-", "<"):
            back = self.take("<-") or (self.take("<") and (self.need("-") or True))
            if not back:
                self.need("-")
            var = kind = None
            if self.take("["):
                if not self.peek(":", "]"):
                    var = self.name()
                if self.take(":"):
                    kind = self.name()
                self.need("]")
            out_ = self.take("->")
            if not out_:
                self.need("-")
            out += [Edge(kind, "in" if back else "out" if out_ else "any", var), self.node()]
        return out

    def node(self) -> Node:
        self.need("(")
        if self.peek(":", ")", "{"):
            self.fresh += 1
            node = Node(f"_anon{self.fresh}")
        else:
            node = Node(self.name())
        if self.take(":"):
            node.kind = self.name()
        if self.take("{"):
            while True:
                k = self.name()
                self.need(":")
                node.props[k] = self.literal()
                if not self.take(","):
                    break
            self.need("}")
        self.need(")")
        return node

    def literal(self):
        sign = -1 if self.take("-") else 1
        if self.i >= len(self.tokens):
            raise QuerySyntaxError("expected a literal")
        kind, v = self.tokens[self.i]
        self.i += 1
        if kind == "num":
            return sign * (float(v) if re.search(r"[.eE]", v) else int(v))
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", v[1:-1])
        if kind == "word" and v.upper() in ("TRUE", "FALSE"):
            return v.upper() == "TRUE"
        if kind == "word" and v.upper() == "NULL":
            return None
        raise QuerySyntaxError(f"expected a literal, got {v!r}")

    def items(self) -> list:
        out = []
        while True:
            e = self.expr()
            out.append((e, self.name() if self.take("AS") else None))
            if not self.take(","):
                return out

    def expr(self):
        left = self.conj()
        while self.take("OR"):
            left = ("or", left, self.conj())
        return left

    def conj(self):
        left = self.neg()
        while self.take("AND"):
            left = ("and", left, self.neg())
        return left

    def neg(self):
        return ("not", self.neg()) if self.take("NOT") else self.compare()

    def compare(self):
        left = self.add()
        if self.peek("=", "!=", "<>", "<", "<=", ">", ">="):
            op = self.tokens[self.i][1]
            self.i += 1
            return ("cmp", op, left, self.add())
        if self.take("IS"):
            no = self.take("NOT")
            self.need("NULL")
            return ("not", ("null", left)) if no else ("null", left)
        no = self.peek("NOT") and self.peek("IN", "LIKE", "BETWEEN", "CONTAINS", ahead=1) and self.take("NOT")
        out = None
        if self.take("IN"):
            close = "]" if self.take("[") else (self.need("("), ")")[1]
            values = [self.literal()]
            while self.take(","):
                values.append(self.literal())
            self.need(close)
            out = ("in", left, values)
        elif self.take("BETWEEN"):
            low = self.add()
            self.need("AND")
            out = ("and", ("cmp", ">=", left, low), ("cmp", "<=", left, self.add()))
        elif self.take("LIKE"):
            out = ("like", left, self.literal())
        elif self.take("CONTAINS"):
            out = ("contains", left, self.literal())
        elif self.take("STARTS"):
            self.need("WITH")
            out = ("starts", left, self.literal())
        elif self.take("ENDS"):
            self.need("WITH")
            out = ("ends", left, self.literal())
        return left if out is None else ("not", out) if no else out

    def add(self):
        left = self.mul()
        while self.peek("+", "-"):
            op = self.tokens[self.i][1]
            self.i += 1
            left = ("arith", op, left, self.mul())
        return left

    def mul(self):
        left = self.atom()
        while self.peek("*", "/", "%"):
            op = self.tokens[self.i][1]
            self.i += 1
            left = ("arith", op, left, self.atom())
        return left

    def atom(self):
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        if self.take("CASE"):
            arms = []
            while self.take("WHEN"):
                c = self.expr()
                self.need("THEN")
                arms.append((c, self.expr()))
            other = self.expr() if self.take("ELSE") else ("lit", None)
            self.need("END")
            return ("case", arms, other)
        if self.take("EXISTS"):
            self.need("{")
            self.take("MATCH")
            p = self.pattern()
            self.need("}")
            return ("exists", p)
        if self.i < len(self.tokens) and self.tokens[self.i][0] == "word" and not self.peek("TRUE", "FALSE", "NULL"):
            name = self.name()
            if self.take("("):
                return self.call(name.upper())
            if self.take("."):
                return ("prop", name, self.name())
            return ("var", name)
        return ("lit", self.literal())

    def call(self, name: str):
        if name in AGGREGATES:
            distinct = self.take("DISTINCT")
            arg = None if self.take("*") else self.expr()
            self.need(")")
            return ("agg", name, distinct, arg)
        args, named = [], {}
        while not self.peek(")"):
            if self.i + 1 < len(self.tokens) and self.tokens[self.i][0] == "word" and self.peek("=", ahead=1):
                k = self.name().lower()
                self.need("=")
                named[k] = self.literal()
            else:
                args.append(self.expr())
            if not self.take(","):
                break
        self.need(")")
        return ("call", name, args, named)


def parse(text: str) -> Query:
    return Parser(text).query()


def _has_agg(e) -> bool:
    return isinstance(e, tuple) and (e[:1] == ("agg",) or any(_has_agg(x) for x in e)) or isinstance(e, list) and any(_has_agg(x) for x in e)


class Engine:
    """entities: (entity_id, entity_type, name, lat, lon, ..., property columns); edges: (source_id, target_id, rel_type).

    history: states of entities with a time `ts`; of equal times the greater following columns
    win.  now: the instant of now(), the start of the query where it is not given.
    """

    def __init__(self, entities: DataFrame, edges: DataFrame | None = None, history: DataFrame | None = None, now=None):
        self.entities, self.edges, self.history, self.now = entities, edges, history, now

    def run(self, text: str) -> DataFrame:
        q = parse(text)
        if q.at is not None or q.since is not None:
            return self._in_time(q)._run(q)
        return self._run(q)

    def _in_time(self, q: Query) -> Engine:
        if self.history is None:
            raise ValueError("this engine has no history")
        rows = self.history
        if q.at is not None:
            rows = store.as_of(rows, self._instant(q.at))
        if q.since is not None:
            rows = rows.where(F.col("ts") >= self._instant(q.since))
        return Engine(rows, self.edges, self.history, self.now)

    def _instant(self, e) -> Column:
        return self._expr(self.history, e).cast("timestamp")

    def _run(self, q: Query) -> DataFrame:
        df, bound = None, set()
        near = self._near_pairs(q.where)
        for p in q.patterns:
            df = self._placed(df, p, bound, near)
        for p in q.optional:
            df = self._match(df, p, bound, "left")
        if q.where is not None:
            df = self._filter(df, q.where)
        for items, where in q.stages:
            df = self._project(df, self._carried(df, items), None, None, distinct=False)
            if where is not None:
                df = df.where(self._expr(df, where))
        if any(_has_agg(e) for e, _ in q.items) or q.group:
            names = [self._label(e, a, i) for i, (e, a) in enumerate(q.items)]
            df = self._project(df, q.items, q.group, q.having, q.distinct)
            order = [self._after(df, e, q.items, names) for e, _ in q.order]
        else:
            order = [self._expr(df, e, dict((a, x) for x, a in q.items if a)) for e, _ in q.order]
            if q.distinct:
                df = self._project(df, q.items, None, None, True)
                order = [self._after(df, e, q.items, [self._label(x, a, i) for i, (x, a) in enumerate(q.items)]) for e, _ in q.order]
        if order:
            df = df.orderBy(*[o.desc_nulls_last() if down else o.asc_nulls_first() for o, (_, down) in zip(order, q.order)])
        if q.limit is not None:
            df = df.limit(q.limit)
        if not (any(_has_agg(e) for e, _ in q.items) or q.group or q.distinct):
            df = self._project(df, q.items, None, None, False)
        return df

    def explain(self, text: str) -> str:
        return self.run(text)._jdf.queryExecution().toString()

    def _scan(self, node: Node) -> DataFrame:
        rows = self.entities
        columns = {c.lower(): c for c in rows.columns}
        if node.kind:
            rows = rows.where(F.lower("entity_type") == node.kind.lower())
        for k, v in node.props.items():
            c = columns.get(BUILT_IN.get(k, k).lower())
            rows = rows.where((F.col(c) == F.lit(v)) if c else F.lit(False))
        return rows.select(*[F.col(c).alias(f"{node.var}__{c}") for c in rows.columns])

    def _near_pairs(self, e) -> list[tuple[str, str, float]]:
        """(a, b, km) of the NEAR(a, b) that every row must meet."""
        if e is None:
            return []
        if e[0] == "and":
            return self._near_pairs(e[1]) + self._near_pairs(e[2])
        if e[0] == "call" and e[1] == "NEAR" and len(e[2]) == 2 and "radius_km" in e[3] and all(a[0] == "var" for a in e[2]):
            return [(e[2][0][1], e[2][1][1], float(e[3]["radius_km"]))]
        return []

    def _placed(self, df, pattern: list, bound: set, near: list):
        """A further pattern that shares no variable joins by a grid over the unit sphere where a NEAR ties it to the others.

        Cells are as wide as the radius; one side goes to its own cell, the other to all around it.
        """
        fresh = {n.var for n in pattern[::2]}
        if df is None or fresh & bound:
            return self._match(df, pattern, bound, "inner")
        tie = next(((a, b, r) if a in bound else (b, a, r) for a, b, r in near if (a in bound and b in fresh) or (b in bound and a in fresh)), None)
        if tie is None:
            return self._match(df, pattern, bound, "inner")
        a, b, km = tie
        other = self._match(None, pattern, set(), "inner")
        bound |= fresh
        width = max(1.001 * km / geo.EARTH_KM, 1e-4)

        def cells(rows: DataFrame, var: str, tag: str) -> DataFrame:
            la, lo = F.radians(F.col(f"{var}__lat")), F.radians(F.col(f"{var}__lon"))
            axes = (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))
            return rows.withColumns({f"_{tag}{i}": F.floor(c / width) for i, c in enumerate(axes)})

        left, right = cells(df, a, "p"), cells(other, b, "q")
        for i in range(3):
            right = right.withColumn(f"_q{i}", F.explode(F.array(*[F.col(f"_q{i}") + k for k in (-1, 0, 1)])))
        on = [F.col(f"_p{i}") == F.col(f"_q{i}") for i in range(3)]
        return left.join(right, on).drop(*[f"_{t}{i}" for t in "pq" for i in range(3)])

    def _match(self, df, pattern: list, bound: set, how: str):
        chain = df
        first = pattern[0]
        if first.var not in bound:
            rows = self._scan(first)
            chain = rows if chain is None else chain.crossJoin(rows)
            bound.add(first.var)
        left = first
        for edge, node in zip(pattern[1::2], pattern[2::2]):
            if self.edges is None:
                raise ValueError("this engine has no relationships")
            e = self.edges if edge.kind is None else self.edges.where(F.lower("rel_type") == edge.kind.lower())
            out = e.select(F.col("source_id").alias("_from"), F.col("target_id").alias("_to"), F.col("rel_type").alias("_rel"))
            turned = e.select(F.col("target_id").alias("_from"), F.col("source_id").alias("_to"), F.col("rel_type").alias("_rel"))
            hop = out if edge.direction == "out" else turned if edge.direction == "in" else out.unionByName(turned)
            if edge.var:
                hop = hop.withColumnRenamed("_rel", f"{edge.var}__type")
            else:
                hop = hop.drop("_rel")
            if node.var in bound:
                hop = hop.withColumnsRenamed({"_from": "_f", "_to": "_t"})
                chain = chain.join(hop, (F.col(f"{left.var}__entity_id") == F.col("_f")) & (F.col(f"{node.var}__entity_id") == F.col("_t")), how).drop("_f", "_t")
            else:
                far = hop.join(self._scan(node), F.col("_to") == F.col(f"{node.var}__entity_id")).drop("_to")
                chain = chain.join(far, F.col(f"{left.var}__entity_id") == F.col("_from"), how).drop("_from")
                bound.add(node.var)
            left = node
        return chain

    def _filter(self, df: DataFrame, e) -> DataFrame:
        if e[0] == "and":
            return self._filter(self._filter(df, e[1]), e[2])
        if e[0] == "exists" or (e[0] == "not" and e[1][0] == "exists"):
            keys, on = self._witnesses(df, (e if e[0] == "exists" else e[1])[1])
            return df.join(keys, on, "left_semi" if e[0] == "exists" else "left_anti")
        columns = df.columns
        df, e = self._flagged(df, e)
        return df.where(self._expr(df, e)).select(*[F.col(f"`{c}`") for c in columns])

    def _witnesses(self, df: DataFrame, pattern: list) -> tuple[DataFrame, list[Column]]:
        """The keys for which a pattern has a match, and how they meet the rows."""
        inner = self._match(None, pattern, set(), "inner")
        shared = [n.var for n in pattern[::2] if f"{n.var}__entity_id" in df.columns]
        if not shared:
            raise QuerySyntaxError("EXISTS shares no variable with the patterns before it")
        keys = inner.select(*[F.col(f"{v}__entity_id").alias(f"_{v}") for v in shared]).distinct()
        return keys, [F.col(f"{v}__entity_id") == F.col(f"_{v}") for v in shared]

    def _flagged(self, df: DataFrame, e) -> tuple[DataFrame, tuple]:
        """An EXISTS inside an expression as a column, true where the pattern has a match."""
        if not isinstance(e, tuple):
            return df, e
        if e[:1] == ("exists",):
            self.flags = getattr(self, "flags", 0) + 1
            name = f"_exists{self.flags}"
            keys, on = self._witnesses(df, e[1])
            keys = keys.withColumn(name, F.lit(True))
            return df.join(keys, on, "left").drop(*[c for c in keys.columns if c != name]), ("flag", name)
        out = []
        for x in e:
            df, y = self._flagged(df, x)
            out.append(y)
        return df, tuple(out)

    def _column(self, df: DataFrame, var: str, prop: str) -> Column:
        own = {c.lower(): c for c in df.columns}
        c = own.get(f"{var}__{BUILT_IN.get(prop.lower(), prop)}".lower()) or own.get(f"{var}__{prop}".lower())
        if c is None and not any(x.startswith(f"{var}__") for x in df.columns):
            raise QuerySyntaxError(f"unknown variable {var!r}")
        return F.col(f"`{c}`") if c else F.lit(None)

    def _is_text(self, df: DataFrame, e) -> bool:
        """Whether an expression is known to be text: a literal, a text property, or a sum with one."""
        if e[0] == "lit":
            return isinstance(e[1], str)
        if e[0] == "prop":
            own = {c.lower(): c for c in df.columns}
            c = own.get(f"{e[1]}__{BUILT_IN.get(e[2].lower(), e[2])}".lower()) or own.get(f"{e[1]}__{e[2]}".lower())
            return c is not None and df.schema[c].dataType.typeName() == "string"
        return e[0] == "arith" and e[1] == "+" and any(self._is_text(df, y) for y in e[2:4])

    def _alike(self, df: DataFrame, left, right, x) -> tuple[Column, Column]:
        """Both sides of a comparison; text against a number compares as a number and is NULL where it is none."""
        a, b = x(left), x(right)
        number = lambda y: y[0] == "lit" and isinstance(y[1], (int, float)) and not isinstance(y[1], bool) or (y[0] == "arith" and not self._is_text(df, y))
        if self._is_text(df, left) and number(right):
            a = a.try_cast("double")
        elif self._is_text(df, right) and (number(left) or (left[0] == "prop" and not self._is_text(df, left))):
            b = b.try_cast("double") if right[0] != "lit" or not self._is_bool(df, left) else b
        return a, b

    def _is_bool(self, df: DataFrame, e) -> bool:
        own = {c.lower(): c for c in df.columns}
        c = own.get(f"{e[1]}__{e[2]}".lower()) if e[0] == "prop" else None
        return c is not None and df.schema[c].dataType.typeName() == "boolean"

    def _geometry(self, df: DataFrame, arg) -> tuple[Column, Column]:
        return self._column(df, arg[1], "lat"), self._column(df, arg[1], "lon")

    def _expr(self, df: DataFrame, e, aliases: dict | None = None) -> Column:
        x = lambda y: self._expr(df, y, aliases)
        kind = e[0]
        if kind == "lit":
            return F.lit(e[1])
        if kind == "prop":
            return self._column(df, e[1], e[2])
        if kind == "var":
            if aliases and e[1] in aliases:
                return x(aliases[e[1]])
            if e[1] in df.columns:
                return F.col(f"`{e[1]}`")
            own = [c for c in df.columns if c.startswith(e[1] + "__")]
            if own:
                return F.to_json(F.struct(*[F.col(f"`{c}`").alias(c.split("__", 1)[1]) for c in own]))
            raise QuerySyntaxError(f"unknown name {e[1]!r}")
        if kind == "and":
            return x(e[1]) & x(e[2])
        if kind == "or":
            return x(e[1]) | x(e[2])
        if kind == "not":
            return ~x(e[1])
        if kind == "cmp":
            a, b = self._alike(df, e[2], e[3], x)
            return {"=": a == b, "!=": a != b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e[1]]
        if kind == "flag":
            return F.coalesce(F.col(e[1]), F.lit(False))
        if kind == "null":
            return x(e[1]).isNull()
        if kind == "in":
            return x(e[1]).isin(e[2])
        if kind == "like":
            return x(e[1]).like(e[2]) if "%" in e[2].strip("%") or "_" in e[2] else x(e[1]).contains(e[2].strip("%")) if e[2].startswith("%") and e[2].endswith("%") else x(e[1]).like(e[2])
        if kind in ("contains", "starts", "ends"):
            return getattr(x(e[1]), {"contains": "contains", "starts": "startswith", "ends": "endswith"}[kind])(e[2])
        if kind == "arith":
            texts = [self._is_text(df, y) for y in e[2:4]]
            if e[1] == "+" and any(texts):
                return F.concat(x(e[2]).cast("string"), x(e[3]).cast("string"))
            # text in arithmetic counts as its number; a division by zero is NULL
            a, b = (x(y).try_cast("double") if text else x(y) for y, text in zip(e[2:4], texts))
            return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b), "%": F.try_mod(a, b)}[e[1]]
        if kind == "case":
            c = None
            for cond, value in e[1]:
                c = F.when(x(cond), x(value)) if c is None else c.when(x(cond), x(value))
            return c.otherwise(x(e[2]))
        if kind == "agg":
            _, name, distinct, arg = e
            if name == "COUNT":
                if arg is None:
                    return F.count(F.lit(1))
                col = self._column(df, arg[1], "id") if arg[0] == "var" and arg[1] not in df.columns else x(arg)
                return F.countDistinct(col) if distinct else F.count(col)
            col = x(arg)
            if name == "COLLECT":
                return F.array_sort(F.collect_set(col) if distinct else F.collect_list(col))
            return {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[name](col)
        if kind == "call":
            return self._call(df, e, x)
        raise QuerySyntaxError(f"{kind} is not allowed here")

    def _call(self, df: DataFrame, e, x) -> Column:
        _, name, args, named = e
        if name == "NEAR":
            lat, lon = self._geometry(df, args[0])
            if len(args) > 1:
                lat2, lon2 = self._geometry(df, args[1])
                return geo.haversine_km(lat, lon, lat2, lon2) <= float(named["radius_km"])
            return geo.point_in_radius(lat, lon, float(named["lat"]), float(named["lon"]), float(named["radius_km"]))
        if name == "WITHIN":
            lat, lon = self._geometry(df, args[0])
            if "polygon" in named:
                return geo.point_in_polygon(lat, lon, geo.parse_wkt_polygon(named["polygon"]))
            return geo.point_in_bbox(lat, lon, named["min_lat"], named["min_lon"], named["max_lat"], named["max_lon"])
        if name == "DISTANCE":
            lat, lon = self._geometry(df, args[0])
            if len(args) > 1:
                lat2, lon2 = self._geometry(df, args[1])
                return geo.haversine_km(lat, lon, lat2, lon2)
            return geo.haversine_km(lat, lon, float(named["lat"]), float(named["lon"]))
        if name in ("NOW", "TODAY") and not args:
            now = F.current_timestamp() if self.now is None else F.lit(self.now).cast("timestamp")
            return now if name == "NOW" else F.date_trunc("day", now)
        if name == "TIMESTAMP":
            return x(args[0]).cast("timestamp")
        if name == "INTERVAL":
            unit = args[1][1].upper().rstrip("S") if len(args) == 2 and args[1][0] == "var" else ""
            if unit not in UNITS:
                raise QuerySyntaxError("an interval is (number, days | hours | minutes | seconds)")
            return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), x(args[0]).cast("double") * UNITS[unit])
        plain = {"LOWER": F.lower, "UPPER": F.upper, "ABS": F.abs, "LENGTH": F.length, "SIZE": lambda a: F.size(a), "ROUND": lambda a, n=None: F.round(a, 0 if n is None else args[1][1])}
        if name in plain:
            return plain[name](*[x(a) for a in args])
        if name == "COALESCE":
            return F.coalesce(*[x(a) for a in args])
        raise QuerySyntaxError(f"unknown function {name}")

    @staticmethod
    def _label(e, alias: str | None, i: int) -> str:
        return alias or (e[2] if e[0] == "prop" else e[1] if e[0] == "var" else e[1].lower() if e[0] in ("agg", "call") else f"_{i}")

    def _project(self, df: DataFrame, items: list, group, having, distinct: bool) -> DataFrame:
        names = [self._label(e, a, i) for i, (e, a) in enumerate(items)]
        names = [n if names.count(n) == 1 or e[0] != "prop" else f"{e[1]}_{e[2]}" for n, (e, _) in zip(names, items)]
        if group or any(_has_agg(e) for e, _ in items):
            keys = [(self._expr(df, e), n) for n, (e, _) in zip(names, items) if not _has_agg(e)]
            extra = [self._expr(df, g) for g in group or [] if not any(g == e or g == ("var", n) for n, (e, _) in zip(names, items))]
            aggs = [self._expr(df, e).alias(n) for n, (e, _) in zip(names, items) if _has_agg(e)]
            hidden = [self._expr(df, having, {n: e for n, (e, _) in zip(names, items) if _has_agg(e)}).alias("_having")] if having is not None and _has_agg(self._expand(having, items, names)) else []
            df = df.groupBy(*[c.alias(n) for c, n in keys], *extra).agg(*(aggs + hidden or [F.count(F.lit(1)).alias("_n")]))
            if having is not None:
                df = df.where("_having") if hidden else df.where(self._expr(df, having))
            return df.select(*[F.col(f"`{n}`") for n in names])
        keep = []
        for n, (e, a) in zip(names, items):
            keep.append(self._expr(df, e).alias(n))
        df = df.select(*keep)
        return df.distinct() if distinct else df

    @staticmethod
    def _carried(df: DataFrame, items: list) -> list:
        """A variable that a WITH passes on brings all its columns."""
        out = []
        for e, a in items:
            own = [c for c in df.columns if e[0] == "var" and a is None and c.startswith(e[1] + "__")]
            out += [(("prop", e[1], c.split("__", 1)[1]), c) for c in own] or [(e, a)]
        return out

    @staticmethod
    def _expand(e, items, names):
        if isinstance(e, tuple) and e[:1] == ("var",):
            return next((x for (x, _), n in zip(items, names) if n == e[1]), e)
        return tuple(Engine._expand(y, items, names) if isinstance(y, tuple) else y for y in e) if isinstance(e, tuple) else e

    def _after(self, df: DataFrame, e, items, names) -> Column:
        """An order key over an aggregated or distinct result: one of its columns."""
        for n, (x, _) in zip(names, items):
            if e == x or e == ("var", n):
                return F.col(f"`{n}`")
        return self._expr(df, e)

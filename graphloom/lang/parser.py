"""Recursive-descent parser. A statement that is not read to its end is an error."""

from __future__ import annotations

from graphloom.lang import ast
from graphloom.lang.lexer import QueryError, Token, lex

AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}
_CLAUSES = {"MATCH", "OPTIONAL", "WHERE", "WITH", "UNWIND", "RETURN", "ORDER", "SKIP", "LIMIT", "UNION", "CREATE", "MERGE", "SET", "DELETE", "DETACH", "REMOVE", "ON", "AT", "USING", "GROUP", "YIELD"}


class Parser:
    def __init__(self, text: str):
        self.text = text
        self.tokens = lex(text)
        self.i = 0

    # tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def ahead(self, k: int = 1) -> Token:
        return self.tokens[min(self.i + k, len(self.tokens) - 1)]

    def step(self) -> Token:
        self.i += 1
        return self.tokens[self.i - 1]

    def fail(self, wanted: str) -> QueryError:
        found = self.now.text or "the end"
        return QueryError(f"expected {wanted}, found {found!r} at {self.now.at}")

    def word(self, *words: str) -> bool:
        """Whether the next tokens are these words."""
        return all(self.ahead(k).upper == w for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.word(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise self.fail(" ".join(words))

    def sym(self, s: str) -> bool:
        return self.now.kind == "sym" and self.now.text == s

    def take_sym(self, s: str) -> bool:
        if self.sym(s):
            self.i += 1
            return True
        return False

    def need_sym(self, s: str) -> None:
        if not self.take_sym(s):
            raise self.fail(repr(s))

    def name(self, what: str = "a name") -> str:
        if self.now.kind not in ("name", "quoted"):
            raise self.fail(what)
        return self.step().text

    # statements

    def parse(self):
        found = self.statement()
        self.take_sym(";")
        if self.now.kind != "end":
            raise self.fail("the end of the statement")
        return found

    def statement(self):
        for word, profile in (("EXPLAIN", False), ("PROFILE", True)):
            if self.take(word):
                return ast.Explain(self.statement(), profile)
        for word in ("BEGIN", "COMMIT", "ROLLBACK"):
            if self.take(word):
                return ast.Command(word.lower())
        if self.take("FLASHBACK"):
            self.need("TO")
            return ast.Command("flashback", self.time_point())
        if self.take("CALL"):
            return self.call()
        return self.query()

    def time_point(self):
        self.take("TIMESTAMP")
        return self.expression()

    def call(self) -> ast.Call:
        name = self.name("a procedure")
        while self.take_sym("."):
            name += "." + self.name("a procedure")
        self.need_sym("(")
        args = []
        while not self.take_sym(")"):
            args.append(self.expression())
            if not self.sym(")"):
                self.need_sym(",")
        yields = []
        if self.take("YIELD"):
            while True:
                column = self.name("a column")
                yields.append((column, self.name("a name") if self.take("AS") else column))
                if not self.take_sym(","):
                    break
        return ast.Call(name, args, yields)

    def query(self) -> ast.Query:
        clauses = []
        at_time = shards = None
        while True:
            if self.take("OPTIONAL"):
                self.need("MATCH")
                clauses.append(self.match(True))
            elif self.take("MATCH"):
                clauses.append(self.match(False))
            elif self.take("UNWIND"):
                value = self.expression()
                self.need("AS")
                clauses.append(ast.Unwind(value, self.name()))
            elif self.take("WITH"):
                clauses.append(self.projection(False))
            elif self.take("RETURN"):
                clauses.append(self.projection(True))
            elif self.take("CREATE"):
                patterns = [self.pattern()]
                while self.take_sym(","):
                    patterns.append(self.pattern())
                clauses.append(ast.Create(patterns))
            elif self.take("MERGE"):
                clauses.append(self.merge())
            elif self.take("SET"):
                clauses.append(ast.SetProps(self.assignments()))
            elif self.take("REMOVE"):
                items = []
                while True:
                    var = self.name()
                    self.need_sym(".")
                    items.append((var, self.name()))
                    if not self.take_sym(","):
                        break
                clauses.append(ast.Remove(items))
            elif self.word("DETACH") or self.word("DELETE"):
                detach = self.take("DETACH")
                self.need("DELETE")
                names = [self.name()]
                while self.take_sym(","):
                    names.append(self.name())
                clauses.append(ast.Delete(names, detach))
            elif self.word("AT", "TIME") or self.word("AT", "TIMESTAMP"):
                self.i += 2
                at_time = self.expression()
            elif self.take("USING"):
                self.need("SHARD")
                shards = self.shard_list()
            else:
                break
        if not clauses:
            raise self.fail("a statement")
        found = ast.Query(clauses, at_time, shards)
        if self.take("UNION"):
            found.union_all = self.take("ALL")
            found.union = self.query()
        return found

    def shard_list(self) -> list[int]:
        if self.take_sym("["):
            shards = [self.integer()]
            while self.take_sym(","):
                shards.append(self.integer())
            self.need_sym("]")
            return shards
        return [self.integer()]

    def integer(self) -> int:
        if self.now.kind != "int":
            raise self.fail("a whole number")
        return int(self.step().text)

    def match(self, optional: bool) -> ast.Match:
        patterns = [self.pattern()]
        while self.take_sym(","):
            patterns.append(self.pattern())
        return ast.Match(patterns, self.expression() if self.take("WHERE") else None, optional)

    def merge(self) -> ast.Merge:
        pattern = self.pattern()
        on = {"CREATE": [], "MATCH": []}
        while self.take("ON"):
            kind = "CREATE" if self.take("CREATE") else "MATCH"
            if kind == "MATCH":
                self.need("MATCH")
            self.need("SET")
            on[kind] += self.assignments()
        return ast.Merge(pattern, on["CREATE"], on["MATCH"])

    def assignments(self) -> list[tuple[str, str, ast.Expr]]:
        items = []
        while True:
            var = self.name()
            self.need_sym(".")
            prop = self.name("a property")
            self.need_sym("=")
            items.append((var, prop, self.expression()))
            if not self.take_sym(","):
                return items

    def projection(self, final: bool) -> ast.Projection:
        p = ast.Projection([], final=final, distinct=self.take("DISTINCT"))
        if self.take_sym("*"):
            p.star = True
            while self.take_sym(","):
                p.items.append(self.item())
        else:
            p.items.append(self.item())
            while self.take_sym(","):
                p.items.append(self.item())
        if self.take("GROUP", "BY"):
            p.group_by = [self.expression()]
            while self.take_sym(","):
                p.group_by.append(self.expression())
        while True:
            if self.take("ORDER", "BY"):
                while True:
                    key = self.expression()
                    down = self.take("DESC") or self.take("DESCENDING")
                    if not down and not self.take("ASC"):
                        self.take("ASCENDING")
                    p.order.append((key, down))
                    if not self.take_sym(","):
                        break
            elif self.take("SKIP"):
                p.skip = self.expression()
            elif self.take("LIMIT"):
                p.limit = self.expression()
            elif not final and self.take("WHERE"):
                p.where = self.expression()
            else:
                return p

    def item(self) -> ast.Item:
        start = self.now.at
        e = self.expression()
        text = self.text[start : self.tokens[self.i - 1].at + self._width(self.i - 1)].strip()
        if self.take("AS"):
            return ast.Item(e, self.name("an alias"), True)
        return ast.Item(e, text, False)

    def _width(self, k: int) -> int:
        nxt = self.tokens[k + 1].at
        return len(self.text[self.tokens[k].at : nxt].rstrip())

    # patterns

    def pattern(self) -> ast.Pattern:
        var = None
        if self.now.kind in ("name", "quoted") and self.ahead().text == "=" and self.ahead().kind == "sym":
            var = self.name()
            self.need_sym("=")
        if self.take("SHORTEST", "PATH"):
            return self.chain(var, True)
        if self.now.upper in ("SHORTESTPATH", "ALLSHORTESTPATHS") and self.ahead().text == "(":
            every = self.now.upper == "ALLSHORTESTPATHS"
            self.i += 2
            found = self.chain(var, "all" if every else True)
            self.need_sym(")")
            return found
        return self.chain(var, False)

    def chain(self, var: str | None, shortest: bool | str) -> ast.Pattern:
        nodes, rels = [self.node()], []
        while self.sym("-") or self.sym("<-"):
            rels.append(self.rel())
            nodes.append(self.node())
        if shortest and len(rels) != 1:
            raise QueryError("a shortest path has exactly one relationship")
        return ast.Pattern(var, nodes, rels, shortest)

    def node(self) -> ast.NodePattern:
        self.need_sym("(")
        var = self.name() if self.now.kind in ("name", "quoted") else None
        label = self.name("a label") if self.take_sym(":") else None
        props = self.map_body() if self.sym("{") else {}
        self.need_sym(")")
        return ast.NodePattern(var, label, props)

    def map_body(self) -> dict[str, ast.Expr]:
        self.need_sym("{")
        found = {}
        while not self.take_sym("}"):
            key = self.step().text if self.now.kind == "string" else self.name("a key")
            self.need_sym(":")
            found[key] = self.expression()
            if not self.sym("}"):
                self.need_sym(",")
        return found

    def rel(self) -> ast.RelPattern:
        left = self.take_sym("<-")
        if not left:
            self.need_sym("-")
        r = ast.RelPattern(None, [], None, {}, "both")
        if self.take_sym("["):
            if self.now.kind in ("name", "quoted"):
                r.var = self.name()
            if self.take_sym(":"):
                r.types.append(self.name("a type"))
                if self.take_sym(":"):
                    r.port = self.integer()
                while self.take_sym("|"):
                    self.take_sym(":")
                    r.types.append(self.name("a type"))
            if self.take_sym("*"):
                low = self.integer() if self.now.kind == "int" else None
                if self.take_sym(".."):
                    r.hops = (low if low is not None else 1, self.integer() if self.now.kind == "int" else None)
                else:
                    r.hops = (low, low) if low is not None else (1, None)
            if self.sym("{"):
                r.props = self.map_body()
            self.need_sym("]")
        if left:
            self.need_sym("-")
            r.direction = "in"
        elif self.take_sym("->"):
            r.direction = "out"
        else:
            self.need_sym("-")
        return r

    # expressions, loosest first

    def expression(self):
        e = self.conjunction()
        while self.take("OR"):
            e = ("or", e, self.conjunction())
        return e

    def conjunction(self):
        e = self.negation()
        while self.take("AND"):
            e = ("and", e, self.negation())
        return e

    def negation(self):
        if self.word("NOT") and not (self.ahead().kind == "sym" and self.ahead().text in (".", ",", ")")):
            self.step()
            return ("not", self.negation())
        return self.comparison()

    def comparison(self):
        e = self.sum()
        while True:
            if self.now.kind == "sym" and self.now.text in ("=", "<>", "!=", "<", ">", "<=", ">="):
                op = self.step().text
                e = ("cmp", "<>" if op == "!=" else op, e, self.sum())
            elif self.take("IN"):
                e = ("in", e, self.sum())
            elif self.take("STARTS", "WITH"):
                e = ("fn", "startswith", [e, self.sum()])
            elif self.take("ENDS", "WITH"):
                e = ("fn", "endswith", [e, self.sum()])
            elif self.word("CONTAINS") and self.ahead().text != "(":
                self.step()
                e = ("fn", "contains", [e, self.sum()])
            elif self.take("IS", "NULL"):
                e = ("isnull", e, False)
            elif self.take("IS", "NOT", "NULL"):
                e = ("isnull", e, True)
            else:
                return e

    def sum(self):
        e = self.product()
        while self.sym("+") or self.sym("-"):
            e = ("arith", self.step().text, e, self.product())
        return e

    def product(self):
        e = self.unary()
        while self.sym("*") or self.sym("/") or self.sym("%"):
            e = ("arith", self.step().text, e, self.unary())
        return e

    def unary(self):
        if self.take_sym("-"):
            inner = self.unary()
            return ("lit", -inner[1]) if inner[0] == "lit" and isinstance(inner[1], (int, float)) else ("neg", inner)
        e = self.atom()
        while True:
            if self.sym("."):
                self.step()
                e = ("prop", e, self.name("a property"))
            elif self.take_sym("["):
                e = ("index", e, self.expression())
                self.need_sym("]")
            else:
                return e

    def atom(self):
        t = self.now
        if t.kind == "int":
            return ("lit", int(self.step().text))
        if t.kind == "float":
            return ("lit", float(self.step().text))
        if t.kind == "string":
            return ("lit", self.step().text)
        if t.kind == "param":
            return ("param", self.step().text)
        if self.take_sym("("):
            e = self.expression()
            self.need_sym(")")
            return e
        if self.take_sym("["):
            items = []
            while not self.take_sym("]"):
                items.append(self.expression())
                if not self.sym("]"):
                    self.need_sym(",")
            return ("list", items)
        if self.sym("{"):
            return ("map", self.map_body())
        if t.kind == "quoted":
            return ("var", self.step().text)
        if t.kind != "name":
            raise self.fail("an expression")
        call = self.ahead().kind == "sym" and self.ahead().text == "("
        if t.upper in ("TRUE", "FALSE", "NULL") and not call:
            self.step()
            return ("lit", {"TRUE": True, "FALSE": False, "NULL": None}[t.upper])
        if t.upper == "CASE" and not (self.ahead().kind == "sym"  and self.ahead().text in (".", ",", ")", "=")):
            return self.case()
        if t.upper == "EXISTS" and self.ahead().text in ("{", "("):
            return self.exists()
        if call:
            return self.function()
        if t.upper in _CLAUSES and self.ahead().text not in (".", ",", ")"):
            raise self.fail("an expression")
        return ("var", self.step().text)

    def case(self):
        self.step()
        operand = None if self.word("WHEN") else self.expression()
        whens = []
        while self.take("WHEN"):
            test = self.expression()
            self.need("THEN")
            whens.append((test, self.expression()))
        if not whens:
            raise self.fail("WHEN")
        other = self.expression() if self.take("ELSE") else ("lit", None)
        self.need("END")
        return ("case", operand, whens, other)

    def exists(self):
        self.step()
        close = ")" if self.sym("(") else "}"
        self.step()
        self.take("MATCH")
        pattern = self.pattern()
        where = self.expression() if self.take("WHERE") else None
        self.need_sym(close)
        return ("exists", pattern, where)

    def function(self):
        name = self.step().text
        self.need_sym("(")
        if name.lower() in AGGREGATES:
            if self.take_sym("*"):
                self.need_sym(")")
                return ("agg", name.lower(), False, None)
            distinct = self.take("DISTINCT")
            arg = self.expression()
            self.need_sym(")")
            return ("agg", name.lower(), distinct, arg)
        args = []
        while not self.take_sym(")"):
            args.append(self.expression())
            if not self.sym(")"):
                self.need_sym(",")
        return ("fn", name.lower(), args)


def parse(text: str):
    return Parser(text).parse()

"""A small algebra of grammars.

A grammar is immutable and knows three things: the Spark type of its value, whether it
can succeed without consuming (so that a repetition of it is refused when built, not
looped on), and how to match.  Matching has two forms with one meaning: ``regex()``
compiles to one pattern with atomic groups and possessive quantifiers, because a choice
once taken is never retried, plus a function from captured groups to a value column; and
``match()`` walks a Python string.  Grammars that are recursive, call Python or choose
what to parse by a value already parsed raise ``NotRegular`` from ``regex()``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.types import data_type

U64 = T.DecimalType(20, 0)
U64_MOST = (1 << 64) - 1
_STRING = T.StringType()


class GrammarError(ValueError):
    """A grammar that cannot be built."""


class NotRegular(Exception):
    """No pattern expresses this grammar."""


class Abort(Exception):
    """Ends the whole parse: no alternative is tried."""


@dataclass(frozen=True)
class Fail:
    at: int
    message: str


@dataclass(frozen=True)
class Regex:
    """``value`` and ``valid`` take ``group(k)``, the k-th captured group of this part."""

    pattern: str
    groups: int
    value: Callable[[Callable[[int], Column]], Column]
    valid: Callable[[Callable[[int], Column]], Column] | None = None
    #: Failing ``valid`` would send the parser to another branch, which a pattern cannot do.
    soft: bool = False
    #: The match depends on the character that follows it.
    ahead: bool = False

    def alone(self) -> Regex:
        """For elements that are cut out and matched again."""
        if self.ahead:
            raise NotRegular("an element looks at what follows it")
        return self.firm()

    def firm(self) -> Regex:
        if self.soft:
            raise NotRegular("a decoding failure decides a branch")
        return self

    def of(self, text: Column) -> Callable[[int], Column]:
        """Groups of a text known to match as a whole."""
        whole = f"(?s)\\A{self.pattern}\\z"
        return lambda k: F.regexp_extract(text, whole, k)

    def array(self, texts: Column) -> tuple[Column, Column | None]:
        """Values of an array of matched texts, and whether all are valid."""
        valid = None if self.valid is None else F.forall(texts, lambda x: self.valid(self.of(x)))
        return F.transform(texts, lambda x: self.value(self.of(x))), valid


OUT_OF_RANGE = "number out of range"


def _aborted() -> tuple[Column, Column]:
    return F.lit(None).cast("int"), F.lit(OUT_OF_RANGE)


def _here(message: str) -> tuple[Column, Column]:
    return F.lit(0), F.lit(message)


def _either(condition: Column, one: tuple[Column, Column], other: tuple[Column, Column]) -> tuple[Column, Column]:
    return tuple(F.when(condition, a).otherwise(b) for a, b in zip(one, other))


def _and(a: Callable | None, b: Callable | None) -> Callable | None:
    if a is None or b is None:
        return a or b
    return lambda g: a(g) & b(g)


def _shift(fn: Callable | None, by: int) -> Callable | None:
    return None if fn is None else lambda g: fn(lambda k: g(by + k))


class Grammar:
    type: T.DataType = _STRING
    #: Can succeed without consuming.
    nullable: bool = False
    #: Never fails.
    total: bool = False

    def match(self, s: str, i: int):
        """(value, end) or Fail."""
        raise NotImplementedError

    def regex(self) -> Regex:
        raise NotRegular(type(self).__name__)

    def fails(self, text: Column) -> Column:
        """Whether the grammar does not match at the start of a text."""
        r = self.regex()
        pattern = f"(?s)\\A{r.pattern}"
        good = text.rlike(pattern)
        if r.valid is not None:
            good = good & F.coalesce(r.valid(lambda k: F.regexp_extract(text, pattern, k)), F.lit(False))
        return ~good

    def locate(self, text: Column) -> tuple[Column, Column]:
        """Of a text at whose start the grammar fails: the place (null: the parse was ended as a whole) and the message of ``match``."""
        return _aborted()

    def first(self) -> str | None:
        """Content of a character class that every match starts with; None if unknown or empty matches exist."""
        return None

    @property
    def regular(self) -> bool:
        try:
            self.regex()
        except NotRegular:
            return False
        return True

    # combinators
    def map(self, fn: Callable, type: T.DataType | str, sql: Callable[[Column], Column] | None = None) -> Grammar:
        """Transform the value; with ``sql``, the same as a column expression, the grammar stays regular."""
        return Map(self, fn, _type(type), sql)

    def flatten(self, fn: Callable | None = None, type: T.DataType | str | None = None, sql: Callable[[Column], Column] | None = None, message: str = "the value could not be decoded") -> Grammar:
        """Decode the value: None from ``fn`` (or a null from ``sql``) is a parse failure."""
        return Flatten(self, fn or (lambda v: v), _type(type) if type else self.type, sql, message)

    def maybe(self) -> Grammar:
        return Maybe(self)

    def many(self) -> Grammar:
        return Many(self, 0)

    def one_or_more(self) -> Grammar:
        return Many(self, 1)

    def sep_by1(self, separator: Grammar) -> Grammar:
        return SepBy(self, separator)

    def sep_by(self, separator: Grammar) -> Grammar:
        return OrEmpty(SepBy(self, separator))

    def between(self, opening: Grammar, closing: Grammar) -> Grammar:
        return record().skip(opening).keep("val", self).skip(closing).map(lambda v: v["val"], self.type, lambda c: c["val"])

    def ignore(self) -> Grammar:
        return self.map(lambda v: None, _STRING, lambda c: F.lit(None).cast("string"))

    def skip_then(self, other: Grammar) -> Grammar:
        """This, then ``other``; the value is that of ``other``."""
        return record().skip(self).keep("val", other).map(lambda v: v["val"], other.type, lambda c: c["val"])

    def then_skip(self, other: Grammar) -> Grammar:
        return record().keep("val", self).skip(other).map(lambda v: v["val"], self.type, lambda c: c["val"])

    def and_then(self, fn: Callable[[object], Grammar], type: T.DataType | str) -> Grammar:
        """The next grammar depends on the value."""
        return Bind(self, fn, _type(type))


_type = data_type


def quoted(text: str) -> str:
    return re.escape(text)


class Literal(Grammar):
    def __init__(self, text: str):
        self.text, self.nullable, self.total = text, not text, not text

    def match(self, s, i):
        return (self.text, i + len(self.text)) if s.startswith(self.text, i) else Fail(i, f"expected {self.text!r}")

    def locate(self, text):
        return _here(f"expected {self.text!r}")

    def regex(self):
        return Regex(quoted(self.text), 0, lambda g: F.lit(self.text))

    def first(self):
        return quoted(self.text[0]) if self.text else None


class Chars(Grammar):
    """A run of characters of a class, ``least`` at least and ``most`` at most (None: any number)."""

    def __init__(self, cls: str, least: int, most: int | None, expected: str):
        self.cls, self.least, self.most, self.expected = cls, least, most, expected
        self.nullable = self.total = least == 0
        count = "*+" if (least, most) == (0, None) else "++" if (least, most) == (1, None) else "" if (least, most) == (1, 1) else f"{{{least},{'' if most is None else most}}}+"
        self.pattern = f"[{cls}]{count}"
        self._compiled = re.compile(self.pattern, re.S)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_compiled"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._compiled = re.compile(self.pattern, re.S)

    def match(self, s, i):
        m = self._compiled.match(s, i)
        return (m.group(), m.end()) if m else Fail(i, f"expected {self.expected}")

    def locate(self, text):
        return _here(f"expected {self.expected}")

    def regex(self):
        return Regex(f"({self.pattern})", 1, lambda g: g(1))

    def first(self):
        return self.cls if self.least else None


class Until(Grammar):
    def __init__(self, stop: str):
        if len(stop) != 1:
            raise GrammarError("take_until stops at one character")
        self.stop, self.nullable = stop, True

    def match(self, s, i):
        at = s.find(self.stop, i)
        return (s[i:at], at) if at >= 0 else Fail(i, f"character {self.stop!r} not found")

    def locate(self, text):
        return _here(f"character {self.stop!r} not found")

    def regex(self):
        stop = quoted(self.stop)
        return Regex(f"([^{stop}]*+)(?={stop})", 1, lambda g: g(1), ahead=True)


class Rest(Grammar):
    nullable = total = True

    def match(self, s, i):
        return s[i:], len(s)

    def regex(self):
        return Regex("((?s:.*+))", 1, lambda g: g(1))


class Number(Grammar):
    """Decimal digits as an unsigned 64-bit number; more than it holds ends the parse."""

    type = U64

    def __init__(self, most: int | None):
        self.inner = Chars("0-9", 1, most, "a digit" if most == 1 else "digits")

    def match(self, s, i):
        r = self.inner.match(s, i)
        if isinstance(r, Fail):
            return r
        number = int(r[0]) if len(r[0]) < 4000 else U64_MOST + 1
        if number > U64_MOST:
            raise Abort(OUT_OF_RANGE)
        return number, r[1]

    def locate(self, text):
        return _either(self.inner.fails(text), self.inner.locate(text), _aborted())

    def regex(self):
        number = lambda g: g(1).try_cast("decimal(38,0)")
        fits = lambda g: F.coalesce(number(g) <= F.lit(str(U64_MOST)).cast("decimal(38,0)"), F.lit(False))
        return Regex(f"({self.inner.pattern})", 1, lambda g: number(g).try_cast(U64), fits)

    def first(self):
        return "0-9"


class Const(Grammar):
    nullable = total = True

    def __init__(self, value, type: T.DataType):
        self.value, self.type = value, type

    def match(self, s, i):
        return self.value, i

    def regex(self):
        return Regex("", 0, lambda g: F.lit(self.value).cast(self.type))


class Never(Grammar):
    def __init__(self, message: str, type: T.DataType):
        self.message, self.type = message, type

    def match(self, s, i):
        return Fail(i, self.message)

    def locate(self, text):
        return _here(self.message)

    def regex(self):
        return Regex("(?!)", 0, lambda g: F.lit(None).cast(self.type))


class Choice(Grammar):
    """The first part that matches, for good."""

    def __init__(self, parts: Sequence[Grammar]):
        self.parts, self.type = list(parts), parts[0].type
        if any(p.type != self.type for p in parts):
            raise GrammarError("the alternatives of a choice have different types")
        self.nullable, self.total = any(p.nullable for p in parts), any(p.total for p in parts)

    def match(self, s, i):
        failed = []
        for p in self.parts:
            r = p.match(s, i)
            if not isinstance(r, Fail):
                return r
            failed.append(r)
        far = max(failed, key=lambda f: f.at)
        return Fail(far.at, " or ".join(f.message for f in failed))

    def locate(self, text):
        places, messages = zip(*(p.locate(text) for p in self.parts))
        ended = reduce(lambda a, b: a | b, [p.isNull() for p in places])
        far = F.greatest(*places) if len(places) > 1 else places[0]
        every = F.when(ended, F.lit(None).cast("int")).otherwise(far), F.when(ended, F.lit(OUT_OF_RANGE)).otherwise(F.concat_ws(" or ", *messages))
        return _either(text.rlike(f"(?s)\\A{self.regex().pattern}"), _aborted(), every)

    def regex(self):
        taken, at, branches = [], 0, []
        for p in self.parts:
            r = p.regex().firm()
            taken.append(f"({r.pattern})")
            branches.append((at + 1, r))
            at += 1 + r.groups
            if p.total:  # what follows is never tried
                break
            if p.nullable and p is not self.parts[-1]:
                raise NotRegular("an empty match looks like none")

        def pick(part):
            def build(g):
                out = None
                for mark, r in reversed(branches):
                    fn = getattr(r, part)
                    own = F.lit(True) if fn is None else fn(lambda k, mark=mark: g(mark + k))
                    # an alternative that cannot be empty was taken if its group is not
                    out = own if out is None else F.when(g(mark) != "", own).otherwise(out)
                return out

            return build

        valid = pick("valid") if any(r.valid for _, r in branches) else None
        return Regex(f"(?>{'|'.join(taken)})", at, pick("value"), valid, ahead=any(r.ahead for _, r in branches))

    def first(self):
        parts = [p.first() for p in self.parts]
        return "".join(parts) if all(parts) else None


class Maybe(Grammar):
    nullable = total = True

    def __init__(self, inner: Grammar):
        self.inner, self.type = inner, inner.type

    def match(self, s, i):
        r = self.inner.match(s, i)
        return (None, i) if isinstance(r, Fail) else r

    def regex(self):
        r = self.inner.regex().firm()
        if self.inner.total:
            return r
        if self.inner.nullable:
            raise NotRegular("an empty match looks like none")
        one = lambda g: F.when(g(1) != "", r.value(lambda k: g(1 + k)))
        valid = None if r.valid is None else lambda g: (g(1) == "") | r.valid(lambda k: g(1 + k))
        return Regex(f"(?:({r.pattern}))?+", r.groups + 1, one, valid, ahead=r.ahead)


class Many(Grammar):
    def __init__(self, inner: Grammar, least: int):
        if inner.nullable:
            raise GrammarError("a repeated grammar must consume something")
        self.inner, self.least, self.nullable, self.total = inner, least, least == 0, least == 0
        self.type = T.ArrayType(inner.type)

    def match(self, s, i):
        out = []
        while True:
            r = self.inner.match(s, i)
            if isinstance(r, Fail):
                return r if len(out) < self.least else (out, i)
            out.append(r[0])
            i = r[1]

    def locate(self, text):
        # but for a number that ends the parse, only the first element of those wanted can fail
        return _either(text.rlike(f"(?s)\\A{self.inner.regex().pattern}"), _aborted(), self.inner.locate(text)) if self.least else _aborted()

    def regex(self):
        r = self.inner.regex().alone()
        parts = lambda g: F.regexp_extract_all(g(1), F.lit(f"(?s){r.pattern}"), 0)
        return Regex(f"((?:{r.pattern}){'+' if self.least else '*'}+)", 1 + r.groups, lambda g: r.array(parts(g))[0], None if r.valid is None else lambda g: r.array(parts(g))[1])

    def first(self):
        return self.inner.first() if self.least else None


class SepBy(Grammar):
    """One or more, separators dropped; a trailing separator is left over."""

    def __init__(self, inner: Grammar, separator: Grammar):
        if inner.nullable and separator.nullable:
            raise GrammarError("a repeated grammar must consume something")
        self.inner, self.separator, self.nullable, self.total = inner, separator, inner.nullable, inner.total
        self.type = T.ArrayType(inner.type)

    def match(self, s, i):
        r = self.inner.match(s, i)
        if isinstance(r, Fail):
            return r
        out, i = [r[0]], r[1]
        while True:
            sep = self.separator.match(s, i)
            r = sep if isinstance(sep, Fail) else self.inner.match(s, sep[1])
            if isinstance(r, Fail):
                return out, i
            out.append(r[0])
            i = r[1]

    def locate(self, text):
        return _either(text.rlike(f"(?s)\\A{self.inner.regex().pattern}"), _aborted(), self.inner.locate(text))

    def regex(self):
        p, sep = self.inner.regex().alone(), self.separator.regex().alone()
        more = Regex(f"{sep.pattern}{p.pattern}", sep.groups + p.groups, _shift(p.value, sep.groups), _shift(p.valid, sep.groups))
        # one group for the first element, one for the others
        head = lambda g: p.of(g(1))
        tail = lambda g: F.regexp_extract_all(g(2 + p.groups), F.lit(f"(?s){more.pattern}"), 0)
        value = lambda g: F.concat(F.array(p.value(head(g))), more.array(tail(g))[0])
        valid = None if p.valid is None else lambda g: p.valid(head(g)) & more.array(tail(g))[1]
        return Regex(f"({p.pattern})((?:{more.pattern})*+)", 2 + p.groups + more.groups, value, valid)

    def first(self):
        return self.inner.first()


class OrEmpty(Grammar):
    """An array grammar, or the empty array."""

    nullable = total = True

    def __init__(self, inner: Grammar):
        self.inner, self.type = inner, inner.type

    def match(self, s, i):
        r = self.inner.match(s, i)
        return ([], i) if isinstance(r, Fail) else r

    def regex(self):
        r = self.inner.regex().firm()
        if self.inner.total:
            return r
        if self.inner.nullable:
            raise NotRegular("an empty match looks like none")
        one = lambda g: F.when(g(1) != "", r.value(lambda k: g(1 + k))).otherwise(F.array().cast(self.type))
        valid = None if r.valid is None else lambda g: (g(1) == "") | r.valid(lambda k: g(1 + k))
        return Regex(f"(?:({r.pattern}))?+", r.groups + 1, one, valid, ahead=r.ahead)


class Record(Grammar):
    """Parts in order; those kept are the fields of a struct."""

    def __init__(self, parts: tuple = ()):
        self.parts = parts
        self.type = T.StructType([T.StructField(n, p.type) for n, p in parts if n])
        self.nullable, self.total = all(p.nullable for _, p in parts), all(p.total for _, p in parts)

    def keep(self, name: str, part: Grammar) -> Record:
        if any(n == name for n, _ in self.parts):
            raise GrammarError(f"two fields are called {name!r}")
        return Record((*self.parts, (name, part)))

    def skip(self, part: Grammar) -> Record:
        return Record((*self.parts, (None, part)))

    def match(self, s, i):
        out = {}
        for name, p in self.parts:
            r = p.match(s, i)
            if isinstance(r, Fail):
                return r
            if name:
                out[name] = r[0]
            i = r[1]
        return out, i

    def locate(self, text):
        """The first part that fails on what the parts before it leave."""
        place, message, before = None, None, ""
        for _, p in self.parts:
            r = p.regex()
            if not p.total or r.valid is not None:
                after = F.regexp_replace(text, f"(?s)\\A{before}", "") if before else text
                failed, (at, said) = p.fails(after), p.locate(after)
                at = F.length(text) - F.length(after) + at
                place = F.when(failed, at) if place is None else place.when(failed, at)
                message = F.when(failed, said) if message is None else message.when(failed, said)
            before += r.pattern if not isinstance(p, Const) else ""
        return _here("") if place is None else (place, message)

    def regex(self):
        pattern, at, fields, valid, soft, ahead = "", 0, [], None, False, False
        for name, p in self.parts:
            r = p.regex()
            ahead = r.ahead or (ahead and p.nullable)
            pattern += r.pattern if not isinstance(p, Const) else ""
            if name:
                fields.append((name, _shift(r.value, at)))
            valid, soft, at = _and(valid, _shift(r.valid, at)), soft or r.soft, at + r.groups
        value = lambda g: F.struct(*(fn(g).alias(n) for n, fn in fields)) if fields else F.struct()
        return Regex(pattern, at, value, valid, soft, ahead)

    def first(self):
        for _, p in self.parts:
            if not p.nullable:
                return p.first()
            if not isinstance(p, Const):
                return None
        return None


class Map(Grammar):
    def __init__(self, inner: Grammar, fn: Callable, type: T.DataType, sql: Callable | None):
        self.inner, self.fn, self.type, self.sql, self.nullable, self.total = inner, fn, type, sql, inner.nullable, inner.total

    def match(self, s, i):
        r = self.inner.match(s, i)
        return r if isinstance(r, Fail) else (self.fn(r[0]), r[1])

    def locate(self, text):
        return self.inner.locate(text)

    def regex(self):
        if self.sql is None:
            raise NotRegular("a map without a column expression")
        r = self.inner.regex()
        return Regex(r.pattern, r.groups, lambda g: self.sql(r.value(g)).cast(self.type), r.valid, r.soft, r.ahead)

    def first(self):
        return self.inner.first()


class Flatten(Map):
    def __init__(self, inner, fn, type, sql, message):
        super().__init__(inner, fn, type, sql)
        self.message, self.total = message, False

    def match(self, s, i):
        r = super().match(s, i)
        return Fail(i, self.message) if not isinstance(r, Fail) and r[0] is None else r

    def locate(self, text):
        return _either(self.inner.fails(text), self.inner.locate(text), _here(self.message))

    def regex(self):
        r = super().regex()
        return Regex(r.pattern, r.groups, r.value, _and(r.valid, lambda g: r.value(g).isNotNull()), True, r.ahead)


class Bind(Grammar):
    def __init__(self, inner: Grammar, fn: Callable, type: T.DataType):
        self.inner, self.fn, self.type, self.nullable = inner, fn, type, inner.nullable

    def match(self, s, i):
        r = self.inner.match(s, i)
        return r if isinstance(r, Fail) else self.fn(r[0]).match(s, r[1])


#: Grammars made by ``lazy``, by the identity of what makes them; of this process, never pickled.
_MADE: dict[int, tuple[Callable[[], Grammar], Grammar]] = {}
_MADE_MOST = 1024


def _made(make: Callable[[], Grammar]) -> Grammar:
    """What ``make`` gives: building it costs far more than a match, and every level of every text asks for it."""
    held = _MADE.get(id(make))
    if held is None:
        grammar = make()
        if len(_MADE) >= _MADE_MOST:  # makers that are new in every parse
            _MADE.clear()
        # the maker is held too, so its id stays its own
        held = _MADE[id(make)] = make, grammar
    return held[1]


class Lazy(Grammar):
    def __init__(self, make: Callable[[], Grammar], type: T.DataType):
        self.make, self.type = make, type

    def match(self, s, i):
        return _made(self.make).match(s, i)


class Primitive(Grammar):
    def __init__(self, fn: Callable, type: T.DataType, nullable: bool):
        self.fn, self.type, self.nullable = fn, type, nullable

    def match(self, s, i):
        r = self.fn(s, i)
        return Fail(i, r) if isinstance(r, str) else r


class Apply(Grammar):
    """The value of the first part is a function; it is called with the value of the second."""

    def __init__(self, function: Grammar, argument: Grammar, type: T.DataType):
        self.function, self.argument, self.type = function, argument, type
        self.nullable = function.nullable and argument.nullable

    def match(self, s, i):
        f = self.function.match(s, i)
        if isinstance(f, Fail):
            return f
        r = self.argument.match(s, f[1])
        return r if isinstance(r, Fail) else (f[0](r[0]), r[1])


# leaves and constructors
def lit(text: str) -> Grammar:
    return Literal(text)


def chars(cls: str, *, least: int = 1, most: int | None = None) -> Grammar:
    """A run of characters of a class, written as the inside of ``[...]``."""
    return Chars(cls, least, most, f"one of [{cls}]")


def one(cls: str) -> Grammar:
    return Chars(cls, 1, 1, f"one of [{cls}]")


def any_char() -> Grammar:
    return Chars(r"\s\S", 1, 1, "a character, but the input ended")


def take_while(cls: str) -> Grammar:
    return Chars(cls, 0, None, "")


def take_until(stop: str) -> Grammar:
    return Until(stop)


def rest() -> Grammar:
    return Rest()


text = rest


def utf8_text() -> Grammar:
    """All the rest of a binary column (``parse_bytes``) as text; a failure where it is no UTF-8."""

    def decoded(v):
        try:
            return v.encode("latin-1").decode("utf-8")
        except UnicodeError:
            return None

    sql = lambda c: F.try_validate_utf8(F.encode(c, "ISO-8859-1").cast("string"))
    return rest().flatten(decoded, "string", sql, "the bytes are no UTF-8")


def digit() -> Grammar:
    return Number(1)


def digits() -> Grammar:
    return Number(None)


def const(value, type: T.DataType | str = _STRING) -> Grammar:
    return Const(value, _type(type))


def fail(message: str, type: T.DataType | str = _STRING) -> Grammar:
    return Never(message, _type(type))


def alt(a: Grammar, b: Grammar) -> Grammar:
    return Choice([a, b])


def one_of(parts: Sequence[Grammar]) -> Grammar:
    return Choice(parts) if parts else Never("the list of alternatives was empty", _STRING)


def record() -> Record:
    return Record()


def apply(function: Grammar, argument: Grammar, type: T.DataType | str) -> Grammar:
    return Apply(function, argument, _type(type))


def map2(a: Grammar, b: Grammar, fn: Callable, type: T.DataType | str, sql: Callable[[Column, Column], Column] | None = None) -> Grammar:
    return record().keep("a", a).keep("b", b).map(lambda v: fn(v["a"], v["b"]), type, sql and (lambda c: sql(c["a"], c["b"])))


def map3(a: Grammar, b: Grammar, c: Grammar, fn: Callable, type: T.DataType | str, sql: Callable[[Column, Column, Column], Column] | None = None) -> Grammar:
    return record().keep("a", a).keep("b", b).keep("c", c).map(lambda v: fn(v["a"], v["b"], v["c"]), type, sql and (lambda x: sql(x["a"], x["b"], x["c"])))


def lazy(make: Callable[[], Grammar], type: T.DataType | str) -> Grammar:
    """For recursion: ``make`` is called when the grammar is first met in a parse, and what it gives is kept for other parses."""
    return Lazy(make, _type(type))


def primitive(fn: Callable[[str, int], tuple | str], type: T.DataType | str, *, nullable: bool = False) -> Grammar:
    """``fn(text, place)`` returns (value, end), or a message if it fails."""
    return Primitive(fn, _type(type), nullable)

"""Transformation rules.

A rule names the target column it fills, the source columns it reads and the
expression between them. Rules only build Columns; a load places all of them
in one ``select``, so they run in a single scan stage.

``raw()`` is the outcome before a default replaces NULL. The cast-error check
compares it with the input: a filled input with an empty outcome is an error.
``output_width()`` is the text length an expression is known to produce.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import from_epoch_millis, json_path

# Text lengths of digest and timestamp outputs.
SHA2_WIDTH = {224: 56, 256: 64, 512: 128}
MD5_WIDTH = 32
TIMESTAMP_TEXT_WIDTH = 40


def src(name: str) -> Column:
    """A source column; loads alias the source as ``src``."""
    return F.col(f"src.`{name}`")


@dataclass(frozen=True)
class Rule:
    target: str

    #: True when an empty outcome for a filled input counts as a cast error.
    casts = False

    @property
    def inputs(self) -> tuple[str, ...]:
        return (self.source,)

    @property
    def source(self) -> str:
        return getattr(self, "col", None) or self.target

    def raw(self) -> Column:
        raise NotImplementedError

    def column(self) -> Column:
        return self.raw()

    def failed(self) -> Column:
        """Whether a filled input gave no outcome; only asked where ``casts``."""
        return src(self.source).isNotNull() & self.raw().isNull()

    def output_width(self, source_widths: Mapping[str, int]) -> int | None:
        return None


@dataclass(frozen=True)
class Rename(Rule):
    col: str

    def raw(self) -> Column:
        return src(self.col)


@dataclass(frozen=True)
class JsonField(Rule):
    col: str
    path: str
    dtype: str = "string"
    is_variant: bool = False

    @property
    def casts(self) -> bool:
        return self.dtype != "string"

    def raw(self) -> Column:
        return json_path(src(self.col), self.path, self.dtype, self.is_variant)

    def failed(self) -> Column:
        # a missing key is no error, a value of another type is
        return json_path(src(self.col), self.path, "string", self.is_variant).isNotNull() & self.raw().isNull()


def json_fields(col: str, fields: Mapping[str, str], is_variant: bool = False) -> list[JsonField]:
    """Several columns out of one document. The shared parse is a common
    subexpression, so each row is parsed once."""
    return [JsonField(t, col, p, is_variant=is_variant) for t, p in fields.items()]


@dataclass(frozen=True)
class ToDate(Rule):
    """First format that reads the text wins; NULL when none does."""

    col: str | None = None
    formats: tuple[str, ...] = ("yyyy-MM-dd",)
    casts = True

    def raw(self) -> Column:
        return F.coalesce(*[F.try_to_date(src(self.source), f) for f in self.formats])


@dataclass(frozen=True)
class ToTimestamp(Rule):
    col: str | None = None
    fmt: str | None = None
    casts = True

    def raw(self) -> Column:
        if self.fmt is None:
            return src(self.source).try_cast("timestamp_ntz")
        return F.try_to_timestamp(src(self.source), F.lit(self.fmt)).cast("timestamp_ntz")


@dataclass(frozen=True)
class NumToDecimal(Rule):
    """Numeric to decimal directly, never by way of text. Overflow fails the
    load rather than turning into the default."""

    col: str | None = None
    precision: int = 18
    scale: int = 2
    default: int | None = 0

    @property
    def _type(self) -> str:
        return f"decimal({self.precision},{self.scale})"

    def raw(self) -> Column:
        return src(self.source).cast(self._type)

    def column(self) -> Column:
        if self.default is None:
            return self.raw()
        return F.coalesce(self.raw(), F.lit(self.default).cast(self._type))


@dataclass(frozen=True)
class StrToDecimal(Rule):
    """Text to decimal after removing ``strip``; NULL for junk."""

    col: str | None = None
    precision: int = 18
    scale: int = 2
    strip: str | None = None
    casts = True

    def raw(self) -> Column:
        text = src(self.source)
        if self.strip:
            text = F.replace(text, F.lit(self.strip), F.lit(""))
        return text.try_cast(f"decimal({self.precision},{self.scale})")


@dataclass(frozen=True)
class EpochMs(Rule):
    col: str | None = None

    def raw(self) -> Column:
        return from_epoch_millis(src(self.source))


@dataclass(frozen=True)
class Mask(Rule):
    col: str | None = None
    bits: int = 256

    def raw(self) -> Column:
        return F.sha2(src(self.source).cast("string"), self.bits)

    def output_width(self, source_widths: Mapping[str, int]) -> int | None:
        return SHA2_WIDTH[self.bits]


@dataclass(frozen=True)
class Md5(Rule):
    col: str | None = None

    def raw(self) -> Column:
        return F.md5(src(self.source).cast("string"))

    def output_width(self, source_widths: Mapping[str, int]) -> int | None:
        return MD5_WIDTH


@dataclass(frozen=True)
class Coalesce(Rule):
    col: str | None = None
    value: int | float | str = 0

    def raw(self) -> Column:
        return src(self.source)

    def column(self) -> Column:
        return F.coalesce(self.raw(), F.lit(self.value))


@dataclass(frozen=True)
class Trim(Rule):
    """Blanks only; tabs and line ends stay."""

    col: str | None = None

    def raw(self) -> Column:
        return F.trim(src(self.source))


@dataclass(frozen=True)
class Upper(Rule):
    col: str | None = None

    def raw(self) -> Column:
        return F.upper(src(self.source))


@dataclass(frozen=True)
class Lower(Rule):
    col: str | None = None

    def raw(self) -> Column:
        return F.lower(src(self.source))


@dataclass(frozen=True)
class ConcatWords(Rule):
    """Two trimmed columns with a separator; NULL when either is NULL."""

    left: str
    right: str
    sep: str = " "

    @property
    def inputs(self) -> tuple[str, ...]:
        return (self.left, self.right)

    def raw(self) -> Column:
        return F.concat(F.trim(src(self.left)), F.lit(self.sep), F.trim(src(self.right)))

    def output_width(self, source_widths: Mapping[str, int]) -> int | None:
        known = {k.lower(): v for k, v in source_widths.items()}
        parts = [known.get(c.lower()) for c in self.inputs]
        return None if None in parts else sum(parts) + len(self.sep)


@dataclass(frozen=True)
class Flag(Rule):
    """``yes`` above the threshold, else ``no``; NULL counts as not above."""

    col: str
    gt: float
    yes: str = "HIGH"
    no: str = "LOW"

    def raw(self) -> Column:
        return F.when(src(self.col) > F.lit(self.gt), F.lit(self.yes)).otherwise(F.lit(self.no))


@dataclass(frozen=True)
class Decode(Rule):
    """Codes to labels; unmapped codes give NULL. Code lists that are too long
    for a CASE belong in a table: see ``operators.joins.decode_by_table``."""

    col: str | None = None
    labels: tuple[tuple[str | int, str], ...] = ()

    def raw(self) -> Column:
        out = F.when(src(self.source).isNull(), F.lit(None).cast("string"))
        for code, label in self.labels:
            out = out.when(src(self.source) == F.lit(code), F.lit(label))
        return out.otherwise(F.lit(None).cast("string"))


@dataclass(frozen=True)
class Band(Rule):
    """First cut point the value does not exceed gives the label. Above the
    last cut the outcome is ``else_``; NULL and below ``lower`` give NULL."""

    col: str
    cuts: tuple[tuple[float, str], ...]
    lower: float | None = None
    else_: str | None = None
    cast: str | None = None

    @property
    def casts(self) -> bool:
        return self.cast is not None

    def failed(self) -> Column:
        # a number outside all bands is no error, a text that is no number is
        return src(self.col).isNotNull() & src(self.col).try_cast(self.cast).isNull()

    def raw(self) -> Column:
        value = src(self.col)
        if self.cast:
            value = value.try_cast(self.cast)
        out = F.when(value.isNull(), F.lit(None).cast("string"))
        if self.lower is not None:
            out = out.when(value < F.lit(self.lower), F.lit(None).cast("string"))
        for cut, label in self.cuts:
            out = out.when(value <= F.lit(cut), F.lit(label))
        return out.otherwise(F.lit(self.else_).cast("string"))


@dataclass(frozen=True)
class CsvCount(Rule):
    """Number of separated values; empty text counts as one, NULL stays NULL."""

    col: str
    sep: str = ","

    def raw(self) -> Column:
        return F.array_size(F.split(src(self.col), re.escape(self.sep)))


@dataclass(frozen=True)
class ToBool(Rule):
    """Cast form: ``yes``, ``t``, ``1`` and so on; junk gives NULL."""

    col: str | None = None
    casts = True

    def raw(self) -> Column:
        return src(self.source).try_cast("boolean")


@dataclass(frozen=True)
class IsTrue(Rule):
    """CASE form: exactly ``value`` is true, everything else and NULL is false."""

    col: str | None = None
    value: str = "TRUE"

    def raw(self) -> Column:
        return F.coalesce(src(self.source) == F.lit(self.value), F.lit(False))


@dataclass(frozen=True)
class Year(Rule):
    col: str

    def raw(self) -> Column:
        return F.year(src(self.col))


@dataclass(frozen=True)
class Round(Rule):
    col: str | None = None
    digits: int = 2

    def raw(self) -> Column:
        return F.round(src(self.source), self.digits)


@dataclass(frozen=True)
class Replace(Rule):
    col: str | None = None
    old: str = ","
    new: str = ""

    def raw(self) -> Column:
        return F.replace(src(self.source), F.lit(self.old), F.lit(self.new))


@dataclass(frozen=True)
class FormatTs(Rule):
    col: str | None = None
    pattern: str = "yyyy-MM-dd HH:mm:ss.SSS"

    def raw(self) -> Column:
        return F.date_format(src(self.source), self.pattern)

    def output_width(self, source_widths: Mapping[str, int]) -> int | None:
        return TIMESTAMP_TEXT_WIDTH


@dataclass(frozen=True)
class RowRule:
    """A rule that removes rows; it joins the WHERE, never the select list."""

    col: str

    @property
    def inputs(self) -> tuple[str, ...]:
        return (self.col,)

    def keep(self) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class DropEq(RowRule):
    """Keep rows where the column differs from the value. A NULL is not
    different, so NULL rows go as well."""

    value: str | int | float | bool

    def keep(self) -> Column:
        return src(self.col) != F.lit(self.value)


@dataclass(frozen=True)
class DropNull(RowRule):
    def keep(self) -> Column:
        return src(self.col).isNotNull()

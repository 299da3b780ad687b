"""Column functions over FIX text: extraction, fields, lengths, value checks, version names. All but the sum of characters
are built-in expressions.

Text counts in UTF-16 units where the wire rules count characters; for text of the basic plane that is its length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOH = "\x01"
BEGIN = "8=FIX"
_NONE = "\x00"
FIELD = "array<struct<tag:int,value:string>>"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def delimiter(value: str | None) -> str:
    """The delimiter that an option names: SOH (or nothing), \\xHH, or the first character."""
    if not value or value.upper() == "SOH":
        return SOH
    if value.startswith("\\x") and len(value) == 4:
        return chr(int(value[2:], 16))
    return value[0]


def normalised(line: Column | str, delim: str = SOH) -> Column:
    """The line with its delimiter made SOH."""
    return _c(line) if delim == SOH else F.translate(_c(line), delim, SOH)


_START = r"(?<=[\p{javaWhitespace}\x01])(?=8=FIX)"
_MESSAGE = r"(?s)8=FIX.*?\x0110=[0-9]{3}\x01"


def messages(line: Column | str, delim: str = SOH) -> Column:
    """The complete messages of a line, in order; a start after white space or SOH gives up what was open before it."""
    pieces = F.split(normalised(line, delim), _START)
    return F.flatten(F.transform(pieces, lambda p: F.regexp_extract_all(p, F.lit(_MESSAGE), F.lit(0))))


def tail(line: Column | str, delim: str = SOH) -> Column:
    """The message that the line leaves open, or the empty string."""
    last = F.element_at(F.split(normalised(line, delim), _START), -1)
    rest = F.substring_index(F.regexp_replace(last, _MESSAGE, _NONE), _NONE, -1)
    return F.regexp_extract(rest, "(?s)8=FIX.*", 0)


def stable_prefix(content: Column | str, left: Column | str) -> Column:
    """Content before an open message at its end."""
    return F.substring(_c(content), F.lit(1), F.length(_c(content)) - F.length(_c(left)))


def bounded_tail(left: Column | str, most: int = 1 << 20) -> Column:
    """(flushed, kept) of an open message: beyond `most` only what starts at the last message start is kept, if that fits."""
    left = _c(left)
    n = F.length(left)
    at = n - F.locate(BEGIN[::-1], F.reverse(left)) - F.lit(len(BEGIN) - 2)  # 1-based; past the end if there is none
    has = F.contains(left, F.lit(BEGIN)) & (at - 1 >= n - most)
    start = F.when(n <= most, F.lit(1)).when(has, at).otherwise(n + 1).cast("int")
    return F.struct(F.substring(left, F.lit(1), start - 1).alias("flushed"), F.substring(left, start, n).alias("kept"))


def fields(raw: Column | str) -> Column:
    """The fields of a message, in order; fragments without a number before the sign are left out, and so are tags beyond an int."""
    parts = F.filter(F.split(_c(raw), SOH), lambda p: p.rlike("^[0-9]+="))
    both = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).try_cast("int").alias("tag"), F.substr(p, F.locate("=", p) + 1).alias("value")))
    return F.filter(both, lambda f: f["tag"].isNotNull())


def first_value(own: Column | str, tag: int) -> Column:
    return F.try_element_at(F.filter(_c(own), lambda f: f["tag"] == tag), F.lit(1))["value"]


def last_value(own: Column | str, tag: int) -> Column:
    return F.try_element_at(F.filter(_c(own), lambda f: f["tag"] == tag), F.lit(-1))["value"]


def has_tag(own: Column | str, tag: int) -> Column:
    return F.exists(_c(own), lambda f: f["tag"] == tag)


def int_value(value: Column | str, fallback: int = -1) -> Column:
    """The value of a text of digits only, else the fallback."""
    value = _c(value)
    return F.coalesce(F.when(value.rlike(r"^[0-9]+\z"), value.try_cast("int")), F.lit(fallback))


def units(text: Column | str) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(_c(text), "UTF-16BE")) / 2).cast("int")


def _char_sums(nested: bool = False):
    """The sums of the characters of a batch of texts, or arrays of them, by one pass over the bytes; made here so that it travels with the plan."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def sums(text):
        if nested:  # an array of texts a row
            own = sums.flat(text.flatten())
            places = pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(text), 0).to_numpy())]).astype(np.int32))
            return pa.ListArray.from_arrays(places, own, mask=text.is_null())
        return sums.flat(text)

    def flat(text):
        _, places, raw = text.buffers()
        at = np.frombuffer(places, np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
        raw = np.frombuffer(raw or b"", np.uint8)[at[0] : at[-1]]
        upto = np.concatenate([[0], np.cumsum(raw, dtype=np.int64)])
        out = upto[at[1:] - at[0]] - upto[at[:-1] - at[0]]
        if len(raw) and raw.max() > 127:
            for i in np.flatnonzero(pc.not_equal(pc.utf8_length(text), pc.binary_length(text)).fill_null(False).to_numpy(zero_copy_only=False)).tolist():
                out[i] = sum(map(ord, text[i].as_py()))
        return pa.array(out.astype(np.int32), mask=text.is_null().to_numpy(zero_copy_only=False))

    sums.flat = flat
    sums.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(sums, "array<int>" if nested else "int").asNondeterministic()  # else a filter on a text made with it is pushed down and makes it twice


def char_sum(text: Column | str) -> Column:
    """The sum of the text's characters, null for null: a sum over bytes in Arrow batches, as no built-in function adds characters up."""
    return _char_sums()(_c(text))


def char_sums(texts: Column | str) -> Column:
    """char_sum() of each text of an array."""
    return _char_sums(nested=True)(_c(texts))


def digits(number: Column | str, n: int) -> Column:
    """n decimal digits of a number, by its floor modulus."""
    return F.lpad(F.pmod(_c(number), F.lit(10**n)).cast("string"), n, "0")


def _before_checksum(raw: Column) -> Column:
    """What precedes the last checksum field, its SOH included; null if there is none."""
    at = F.length(raw) - F.locate("=01\x01", F.reverse(raw)) - 2
    return F.when(F.contains(raw, F.lit("\x0110=")), F.substring(raw, F.lit(1), at))


def expected_checksum(raw: Column | str) -> Column:
    """The checksum that a message should state; null where it has no checksum field."""
    return F.pmod(char_sum(_before_checksum(_c(raw))), F.lit(256))


def expected_length(raw: Column | str) -> Column:
    """The body length that a message should state, from the end of the first text like a length field; null where one end is missing."""
    raw = _c(raw)
    before = _before_checksum(raw)
    nine = F.locate("9=", raw)
    start = F.greatest(nine, F.lit(1))
    end = F.instr(F.substr(raw, start), SOH) + start - 1
    return F.when(before.isNotNull() & (F.instr(F.substr(raw, start), SOH) > 0), F.length(before) - end)


def encode(begin: Column | str, body: Column | str) -> Column:
    """A message from its BeginString and body (fields from MsgType on, each ended by SOH), with length and checksum."""
    begin = F.lit(begin) if isinstance(begin, str) else begin
    head = F.concat(F.lit("8="), begin, F.lit(f"{SOH}9="), units(body).cast("string"), F.lit(SOH), _c(body))
    return F.concat(head, F.lit("10="), digits(F.pmod(char_sum(head), F.lit(256)), 3), F.lit(SOH))


def body_of(own: Column | str) -> Column:
    """An array of fields as a body for encode()."""
    return F.array_join(F.transform(_c(own), lambda f: F.concat(f["tag"].cast("string"), F.lit("="), f["value"], F.lit(SOH))), "")


def is_integer(value: Column | str) -> Column:
    return _c(value).rlike(r"^[0-9]+\z")


def is_boolean(value: Column | str) -> Column:
    return _c(value).isin("Y", "N")


def _real_day(day: Column) -> Column:
    """Whether eight digits are a day of the calendar; the year 0000 is a leap year."""
    year = F.when(F.substring(day, 1, 4) == "0000", F.lit("0004")).otherwise(F.substring(day, 1, 4))
    return F.try_to_date(F.concat(year, F.substring(day, 5, 4)), "yyyyMMdd").isNotNull()


_DAY = r"^[0-9]{8}"
_OFFSET = r"(Z|[+-](0[0-9]|1[0-7])([0-5][0-9]([0-5][0-9])?)?|[+-]18(00(00)?)?)?\z"


def is_date(value: Column | str) -> Column:
    """A basic ISO day, with an offset or without."""
    value = _c(value)
    return F.coalesce(value.rlike(_DAY + _OFFSET) & _real_day(F.substring(value, 1, 8)), F.lit(False))


def is_timestamp(value: Column | str) -> Column:
    """A day of eight digits, a hyphen, and an ISO time of day."""
    value = _c(value)
    return F.coalesce(value.rlike(_DAY + r"-([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]{0,9})?)?\z") & _real_day(F.substring(value, 1, 8)), F.lit(False))


#: A blank text for Arrow's regular expressions, which have no name for Java's white space.
BLANK = r"^[\t-\r\x1c-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]*$"


def blank(value: Column | str) -> Column:
    """Whether a text is null or all white space."""
    value = _c(value)
    return value.isNull() | value.rlike(r"^\p{javaWhitespace}*\z")


def blank_to_null(value: Column | str) -> Column:
    return F.when(~blank(value), _c(value))


def version(value: Column | str) -> Column:
    """44, 4.4, FIX44, FIX.4.4 and the like as a dictionary's key."""
    clean = F.replace(F.upper(F.trim(_c(value))), F.lit("."), F.lit(""))
    return F.when(clean.startswith("FIX"), clean).otherwise(F.concat(F.lit("FIX"), clean))


def begin_string_key(value: Column | str) -> Column:
    """The dictionary's key that a BeginString names, null if it names none."""
    clean = F.trim(_c(value))
    return F.when(clean.startswith("FIX"), F.replace(F.upper(clean), F.lit("."), F.lit("")))


def typed(value: Column | str, kind: Column | str) -> Column:
    """(as_long, as_boolean, as_timestamp, as_date, as_decimal) of a value by its FIX type; all but one are null."""
    value, kind = _c(value), _c(kind)
    stamp = F.try_to_timestamp(F.concat(F.substring(value, 1, 8), F.lit(" "), F.substr(value, F.lit(10))), F.lit("yyyyMMdd HH:mm[:ss[.SSSSSS][.SSS]]"))
    return F.struct(
        F.when(kind.isin("INT", "SEQNUM", "NUMINGROUP", "LENGTH"), value.try_cast("bigint")).alias("as_long"),
        F.when((kind == "BOOLEAN") & is_boolean(value), value == "Y").alias("as_boolean"),
        F.when((kind == "UTCTIMESTAMP") & is_timestamp(value), stamp).alias("as_timestamp"),
        F.when(kind.isin("LOCALMKTDATE", "UTCDATEONLY") & is_date(value), F.try_to_date(F.substring(value, 1, 8), "yyyyMMdd")).alias("as_date"),
        F.when(kind.isin("PRICE", "QTY", "AMT", "PRICEOFFSET", "PERCENTAGE", "FLOAT"), value.try_cast("decimal(38,10)")).alias("as_decimal"),
    )

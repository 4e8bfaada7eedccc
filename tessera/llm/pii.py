"""Personal data: patterns propose spans, checksums confirm, context adjusts.

Built from DataFrame functions only. Per kind, ``regexp_extract_all`` gives the
matches and ``split`` the gaps between them; running sums of their lengths give the
code point offsets. A match must pass its kind's validator (Luhn for cards, mod 97
for IBANs, ranges for the rest, digits among letters for secrets). Its score is the
kind's prior, raised by context words and lowered by words that speak against it.
The context is the text's own ``window`` code points on either side of the match,
whatever else is found there; only whole words count. Kinds of ``BASE`` are always
reported; the others from ``threshold`` on. Kinds do not compete: spans of two kinds
may overlap.

Patterns start only where a leftmost match of the plain pattern could start (after
the last match, or after a character outside the first class) and are possessive, so
long runs take linear time and no stack.

Defined cases: a null text is empty; repeated rows are reported each; spans of equal
start are in order of their kind; a very long text is searched whole, in one task; an
empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches whose offsets are summed at once; blocks keep running sums near linear.
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column]
    prior: float
    near: str
    against: str = r"(?!)"
    hint: str = ""  # a string that every match holds


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = _digits(match)
    return F.when(F.length(digits).between(14, 19), F.call_function("luhn_check", digits)).otherwise(False)


def _mod97(match: Column) -> Column:
    packed = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(packed, F.lit(5)), F.left(packed, F.lit(4)))
    letter = lambda c: F.ascii(c) >= 65
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).when(letter(c), (r * 100 + F.ascii(c) - 55) % 97).otherwise((r * 10 + F.ascii(c) - 48) % 97))
    return F.when(F.length(packed).between(15, 34), rest == 1).otherwise(False)


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

def _mixed(match: Column) -> Column:
    """Neither a word nor a number: at least four digits and four letters."""
    return (F.length(_digits(match)) >= 4) & (F.length(F.regexp_replace(match, "[^A-Za-z]", "")) >= 4)


#: Ends of words, in any language, that context words take.
def _words(*words: str) -> str:
    return rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}])"


BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.8, _words("e?-?mails?", "contact", "write", "reach"), _words("example", "no-?reply"), "@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z"), 0.6, _words("ip", "address", "host", "server", "login"), _words("version", "release", "v"), "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _luhn, 0.7, _words("cards?", "visa", "mastercard", "amex", "credit", "debit", "payment", "cvv"), _words("order", "tracking", "serial", "isbn")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(10, 15), 0.7, _words("phone", "call", "tel", "telephone", "mobile", "fax", "contact"), _words("version", "score"), "+"),
)
MORE = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", _mod97, 0.7, _words("iban", "bank", "account", "transfer", "konto", "compte", "cuenta"), _words("serial", "part no")),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda m: F.lit(True), 0.3, _words("ssns?", "social security"), _words("order", "serial"), "-"),
    Kind("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,512}+={0,2}(?![A-Za-z0-9+/_=-])", _mixed, 0.3,
         r"(?<![\p{L}\p{N}])(?:[a-z0-9]+[_-])*(?:tokens?|secrets?|passwords?|passwd|pwd|api_?-?keys?|apikey|keys?|credentials?|auth|authorization|bearer)(?![\p{L}\p{N}])",
         _words("sha", "sha1", "sha256", "md5", "checksum", "digest", "commit")),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _before(sizes: Column) -> Column:
    """For each place of an array of lengths, the sum of those before it."""
    n = F.size(sizes)

    def placed(blocks: Column) -> Column:
        def over(b: Column) -> Column:
            own = F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))
            return _let(F.struct(own.alias("own"), _sum(F.slice(blocks, F.lit(1), b)).alias("base")), lambda s: F.transform(F.sequence(F.lit(0), F.size(s["own"]) - 1), lambda i: s["base"] + _sum(F.slice(s["own"], F.lit(1), i))))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(blocks) - 1), over))

    sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: _sum(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))))
    return _let(sums, placed)


def _around(text: Column, at: Column, end: Column, window: int) -> Column:
    """Lower-case whole words within ``window`` code points before byte ``at`` and from byte
    ``end`` on, of a text as bytes. A word that the window cuts is left out."""
    reach = 4 * (window + 1)  # bytes that so many code points take at most
    first = F.greatest(at - reach, F.lit(0))
    chars = lambda b: F.call_function("make_valid_utf8", b.cast("string"))
    before = F.right(chars(F.call_function("substring", text, first + 1, at - first)), F.lit(window + 1))
    after = F.left(chars(F.call_function("substring", text, end + 1, F.lit(reach))), F.lit(window + 1))
    whole = lambda part, cut: F.when(F.char_length(part) > window, F.regexp_replace(part, cut, "")).otherwise(part)
    return F.lower(F.concat(whole(before, r"^(?:[\p{L}\p{N}]+|.)"), F.lit("\n"), whole(after, r"(?:[\p{L}\p{N}]+|.)\z")))


def spans_of(text: Column, kind: Kind, order: int, base: bool, threshold: float, window: int) -> Column:
    """array<struct<start, kind_no, end, kind, score>> of one kind."""
    empty = F.expr("cast(array() as array<struct<start:bigint,kind_no:int,end:bigint,kind:string,score:double>>)")

    def proposed(both: Column) -> Column:
        gap = lambda i: F.get(both["gaps"], i)
        sizes = lambda length: F.transform(both["matches"], lambda m, i: (length(m) + length(gap(i))).cast("long"))

        def scored(starts: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = F.get(starts["chars"], i) + F.char_length(gap(i))
                at = (F.get(starts["bytes"], i) + F.octet_length(gap(i))).cast("int")

                def rated(context: Column) -> Column:
                    score = F.lit(kind.prior) + F.when(context.rlike(kind.near), 0.25).otherwise(0.0) - F.when(context.rlike(kind.against), 0.25).otherwise(0.0)
                    return F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))

                rating = F.when(kind.valid(m), _let(_around(both["whole"], at, at + F.octet_length(m), window), rated)).otherwise(-1.0)
                return F.struct(start.cast("long").alias("start"), F.lit(order).alias("kind_no"), (start + F.char_length(m)).cast("long").alias("end"), F.lit(kind.name).alias("kind"), rating.alias("score"))

            return F.filter(F.transform(both["matches"], one), lambda s: s["score"] >= (0.0 if base else threshold))

        return _let(F.struct(_let(sizes(F.char_length), _before).alias("chars"), _let(sizes(F.octet_length), _before).alias("bytes")), scored)

    found = _let(F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("matches"), F.split(text, kind.pattern, -1).alias("gaps"), text.cast("binary").alias("whole")), proposed)
    some = text.rlike(kind.pattern)
    if kind.hint:
        some = text.contains(kind.hint) & some
    return F.when(some, found).otherwise(empty)


def detect(docs: DataFrame, threshold: float = 0.5, window: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and spans, array<struct<start, kind_no, end, kind, score>> in
    order of start, then kind; offsets are code points, ends exclusive."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    arrays = [spans_of(F.col("_text"), kind, i, i < len(BASE), threshold, window) for i, kind in enumerate((*BASE, *MORE))]
    return rows.select("doc_id", F.array_sort(F.concat(*arrays)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

"""Scalar text functions as Columns. All but Unicode compatibility normalization are built-in expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..tables import settle

# Character classes as Java regular expressions write them.
WS = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
DIACRITIC = r"[\u064B-\u0655\u0670]"
TATWEEL = "\u0640"
SCRIPTS = {"arabic": r"[\u0600-\u06FF]", "latin": r"[A-Za-z\u00C0-\u024F]"}
#: All other characters, written out: negated classes of such ranges are matched many times slower.
NOT = {LETTER: r"[^\p{L}\p{Nl}\p{No}]", SCRIPTS["arabic"]: r"[\x00-\u05FF\u0700-\x{10FFFF}]", SCRIPTS["latin"]: r"[\x00-@\[-`{-\u00BF\u0250-\x{10FFFF}]"}
#: Line feed, printable ASCII and Latin letters, character by character: Java looks single ones up in a table, but tries ranges one after another.
PLAIN = "".join(f"\\x{c:02X}" for c in [10, *range(32, 127), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7))
#: Latin letters up to U+024F that NFKC leaves alone, quotes, dashes and the euro sign.
PLAIN_TOO = r"\u0100-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0180-\u01C3\u01CD-\u01F0\u01F4-\u024F\u2012-\u2016\u2018-\u2023\u20AC"
#: Of these all that are no letters.
PLAIN_OTHERS = "".join(f"\\x{c:02X}" for c in [10, *range(32, 127)] if not chr(c).isalpha()) + r"\u2012-\u20AC"


def simple(text: Column) -> Column:
    """Only plain characters: the text is NFKC, its white space is spaces and line feeds, its letters are those of the Latin script. A scan then saves many."""
    return text.rlike(rf"\A[{PLAIN}]*\z") | text.rlike(rf"\A[{PLAIN}{PLAIN_TOO}]*\z")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: conditions would work it out anew wherever it stands."""
    return F.transform(F.array(value), use)[0]


def compatible(texts: pa.Array) -> pa.Array:
    """Unicode NFKC. Batches of ASCII, and texts that are normal already, pass as they are."""
    if pc.all(pc.string_is_ascii(texts)).as_py() is not False:
        return texts
    made = pa.array((t if t is None or t.isascii() or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t) for t in (x.as_py() for x in texts)), pa.string(), size=len(texts))
    pa.default_memory_pool().release_unused()  # workers outlive their batches
    return made


def nfkc(text: Column) -> Column:
    """Only texts that aren't simple go to Python, in batches of bounded size."""
    settle(SparkSession.active())
    return F.coalesce(F.arrow_udf(compatible, "string")(F.when(~simple(text), text)), text)


def strip(text: Column) -> Column:
    """Unicode white space off both ends."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(WS), F.regexp_replace(F.regexp_replace(text, rf"\A{WS}++", ""), rf"{WS}++\z", "")).otherwise(text)


def without_tatweel(text: Column) -> Column:
    return F.replace(text, F.lit(TATWEEL), F.lit(""))


def without_diacritics(text: Column) -> Column:
    return F.regexp_replace(text, f"{DIACRITIC}+", "")


def is_tidy(text: Column) -> Column:
    """Simple, and normalized() changes nothing. Others may be tidy as well."""
    twice = text.contains("  ") | text.contains(" \n") | text.contains("\n ") | text.contains("\n\n\n")
    return simple(text) & ~(twice | text.startswith(" ") | text.startswith("\n") | text.endswith(" ") | text.endswith("\n"))


def _tidied(text: Column) -> Column:
    for pattern, to in ((r"\r\n?", "\n"), (r"[\t\f\x0B][ \t\f\x0B]*+| [ \t\f\x0B]++", " "), (r" ++\n *+|\n ++", "\n"), (r"\n{3,}+", "\n\n")):
        text = F.regexp_replace(text, pattern, to)
    return strip(text)


def tidy_whitespace(text: Column) -> Column:
    """Line ends to LF, runs of other blanks to one space, none around line ends, at most one blank line, stripped.

    The patterns match only where something changes: a text that is tidy is scanned, not rebuilt.
    """
    return F.when(is_tidy(text), text).otherwise(_tidied(text))


def normalized(text: Column, *, diacritics: bool = False, compatibility: bool = True) -> Column:
    """NFKC (left out only where input is known to be so), without tatweel and, unless kept, diacritics, with tidy white space."""
    text = nfkc(text) if compatibility else text
    bare = without_tatweel(text)
    return F.when(is_tidy(text), text).otherwise(_tidied(bare if diacritics else without_diacritics(bare)))


def lines(text: Column) -> Column:
    """Pieces between line boundaries, all kinds that Unicode knows. A last boundary adds an empty piece."""
    return F.when(simple(text), F.split(text, "\n", -1)).otherwise(F.split(text, LINE_END, -1))


def words(text: Column) -> Column:
    plain = F.array_remove(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ", -1), "")
    return F.when(simple(text), plain).otherwise(F.filter(F.split(text, f"{WS}+", -1), lambda w: w != ""))


def _counted(text: Column, kind: str) -> Column:
    return F.char_length(F.regexp_replace(text, f"{NOT[kind]}++", ""))


def counted(text: Column, kind: str) -> Column:
    """How many characters are of a class (LETTER or a script): what is left without runs of others. Runs are far fewer than characters."""
    plain = F.lit(0) if kind == SCRIPTS["arabic"] else F.char_length(F.regexp_replace(text, f"[{PLAIN_OTHERS}]++", ""))
    return F.when(simple(text), plain).otherwise(_counted(text, kind))


def script_ratio(text: Column, script: str) -> Column:
    """Characters in the script's block by letters; over 1 where the block has more than letters; 0 without letters."""
    plain = F.when(text.rlike(SCRIPTS["latin"]), 1.0).otherwise(0.0) if script == "latin" else F.lit(0.0)
    return F.when(simple(text), plain).otherwise(let(_counted(text, LETTER), lambda n: safe_divide(_counted(text, SCRIPTS[script]), n)))


def script_share(text: Column, script: str) -> Column:
    """Characters in the script's block by all characters."""
    return safe_divide(counted(text, SCRIPTS[script]), F.char_length(text))


def unique_ratio(parts: Column) -> Column:
    return let(parts, lambda p: safe_divide(F.size(F.array_distinct(p)), F.size(p)))


def fingerprint(text: Column) -> Column:
    """SHA-256 as hexadecimal digits."""
    return F.sha2(text.cast("binary"), 256)


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes: half of what the digits take in an exchange."""
    return F.unhex(fingerprint(text))


def language(text: Column) -> Column:
    """ar, en, mixed or other, by the scripts present."""
    arabic, latin = text.rlike(SCRIPTS["arabic"]), text.rlike("[A-Za-z]")
    return F.when(arabic & latin, "mixed").when(arabic, "ar").when(latin, "en").otherwise("other")


def flattened(text: Column) -> Column:
    """Each line feed as a space."""
    return F.translate(text, "\n", " ")


def changes(text: Column) -> Column:
    """Which steps of normalized() alter the raw text, each on its own: nfkc, tatweel, diacritics, whitespace."""
    found = [("nfkc", nfkc(text) != text), ("tatweel", text.contains(TATWEEL)), ("diacritics", text.rlike(DIACRITIC)), ("whitespace", tidy_whitespace(text) != text)]
    return F.filter(F.array(*[F.when(test, name) for name, test in found]), lambda x: x.isNotNull())


def odd_whitespace(text: Column) -> Column:
    return text.contains("  ") | text.contains("\t") | (strip(text) != text)


def safe_divide(a: Column, b: Column) -> Column:
    """0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a.cast("double") / b)


def head(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def is_hex_digest(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def any_of(text: Column, parts: Iterable[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found

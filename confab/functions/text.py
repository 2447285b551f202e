"""Text columns: repair, folding, tokens, shortening, clocks and literal replacement."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Words that carry no topic, compared after folding (listed as written).
STOPWORDS = (
    "para pero porque como cuando donde quien esto esta este estas "
    "estos desde hasta sobre entre tambien también aunque entonces ahora "
    "aqui aquí alli allí muy más mas menos todo toda todos todas "
    "algo nada cada otro otra otros otras mismo misma hacer hace hecho "
    "tener tiene tienen ser estar está están fue son era hay que "
    "del las los una uno unos unas con sin por sus nos les "
    "dice dijo voy vamos bueno pues vale creo puede pueden quiero"
).split()
# Signal words per kind, folded before counting.
AGREEMENT = "acuerdo acepto sí claro perfecto vale correcto".split()
TENSION = "problema enfado enfadado discusión mentira culpa nunca siempre odio".split()
AFFECTION = "amor quiero cariño juntos abrazo beso confianza apoyo".split()
# Marks that UTF-8 read as a Western single-byte encoding leaves behind.
MOJIBAKE_MARKERS = ("Ã", "Â", "â€", "â€™", "ðŸ", "ƒ")
REPLACEMENT = "�"

TOKEN_PATTERN = r"[\p{L}\p{N}_]{3,}"


def py_fold(value: str) -> str:
    """Case-fold, decompose and drop combining marks."""
    decomposed = unicodedata.normalize("NFKD", value.casefold())
    return "".join(c for c in decomposed if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Letters of the basic plane that fold to exactly one other character."""
    pairs = []
    for code in range(0x80, 0xD800):
        c = chr(code)
        folded = py_fold(c)
        if len(folded) == 1 and folded != c:
            pairs.append((c, folded))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@F.pandas_udf(T.StringType())
def fold_nfkd(values: pd.Series) -> pd.Series:
    """Exact fold for scripts whose letters decompose into several characters."""
    return values.map(lambda v: None if v is None else py_fold(v))


def fold(c: Column) -> Column:
    """Fold inside the JVM: ASCII only needs lower-casing, other letters go through the table."""
    source, target = _fold_table()
    marked = F.translate(F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), r"\p{M}+", ""),
                         source, target)
    return F.when(c.rlike(r"^\p{ASCII}*$"), F.lower(c)).otherwise(marked)


def all_tokens(c: Column) -> Column:
    """Topic words in text order, repeats kept."""
    found = F.array_join(F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), F.lit(0)), " ")
    words = F.transform(F.array(found), lambda t: F.split(fold(t), " "))[0]  # an array of one: found once, not at every place fold reads it
    return F.filter(words, lambda w: ~w.isin("", *dict.fromkeys(STOPWORDS)))


def query_terms(c: Column) -> Column:
    """Lower-cased words of three letters and more, distinct."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), F.lit(0)))


def shorten(c: Column, limit: int) -> Column:
    """Collapse blanks; cut longer texts at the last blank before the limit and add an ellipsis."""
    value = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    head = F.left(value, F.lit(limit - 1))
    back = F.locate(" ", F.reverse(head))
    cut = F.when(back > 0, F.length(head) - back).otherwise(-1)
    return F.when(F.length(value) <= limit, value).otherwise(
        F.concat(F.left(value, F.greatest(F.lit(40), cut)), F.lit("…")))


def clean_text(c: Column, limit: int) -> Column:
    value = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t]+", " "),
                             r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.left(F.regexp_replace(value, r"\n{3,}", "\n\n"), F.lit(limit)), r"(?U)\s+$", "")


def _pad(c: Column, width: int) -> Column:
    s = c.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def subtitle_time(ms: Column, separator: str) -> Column:
    v = F.greatest(F.lit(0), ms.cast("long"))
    h, m = F.floor(v / 3_600_000), F.floor(v % 3_600_000 / 60_000)
    s, r = F.floor(v % 60_000 / 1000), v % 1000
    return F.concat(_pad(h, 2), F.lit(":"), _pad(m, 2), F.lit(":"), _pad(s, 2), F.lit(separator), _pad(r, 3))


def minute_clock(ms: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(ms / 1000))
    return F.concat(_pad(F.floor(s / 60), 2), F.lit(":"), _pad(s % 60, 2))


def short_clock(ms: Column) -> Column:
    s = F.floor(F.greatest(F.lit(0), F.floor(ms)) / 1000)
    hours = F.floor(s / 3600)
    tail = F.concat(_pad(F.floor(s % 3600 / 60), 2), F.lit(":"), _pad(s % 60, 2))
    return F.when(hours > 0, F.concat(_pad(hours, 2), F.lit(":"), tail)).otherwise(tail)


def sanitize_utf8(binary: Column) -> Column:
    """Bytes as text with every invalid sequence shown as U+FFFD."""
    return F.make_valid_utf8(binary.cast("string"))


def _count(c: Column, needle: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)


def mojibake_score(c: Column) -> Column:
    score = _count(c, REPLACEMENT) * 4
    for marker in MOJIBAKE_MARKERS:
        score = score + _count(c, marker)
    return score.cast("long")


def _from_single_byte(c: Column) -> Column:
    """The text whose UTF-8 bytes are the characters of ``c``; NULL where that cannot be."""
    bytes_only = F.when(c.rlike(r"^[\u0000-ÿ]*$"), c)
    return F.try_validate_utf8(F.encode(bytes_only, "ISO-8859-1").cast("string"))


def _cp1252_as_latin(c: Column) -> Column:
    pairs = []
    for b in range(0x80, 0xA0):
        try:
            pairs.append((bytes([b]).decode("cp1252"), chr(b)))
        except UnicodeDecodeError:
            continue
    no_controls = F.when(~c.rlike(r"[\u0080-\u009F]"), c)
    return F.translate(no_controls, "".join(p[0] for p in pairs), "".join(p[1] for p in pairs))


def _repair_round(c: Column) -> Column:
    """The reading with the fewest marks; the present one wins ties, so only real gains count."""
    readings = F.filter(F.array(c, _from_single_byte(c), _from_single_byte(_cp1252_as_latin(c))),
                        lambda t: t.isNotNull())
    scored = F.transform(readings, lambda t, i: F.struct(mojibake_score(t).alias("score"), i.alias("i"),
                                                         t.alias("t")))
    return F.array_min(scored)["t"]


def repair_mojibake(df, columns: list[str]):
    """Undo up to two rounds of wrong decoding; only rows carrying a marker do any work."""
    markers = "[" + REPLACEMENT + "]|" + "|".join(re.escape(m) for m in MOJIBAKE_MARKERS)
    for name in columns:
        c = F.replace(F.col(name), F.lit("Ã" + REPLACEMENT + "frica"), F.lit("África"))
        df = df.withColumn(name, c)
        for _ in range(2):
            df = df.withColumn(name, F.when(F.col(name).rlike(markers), _repair_round(F.col(name)))
                               .otherwise(F.col(name)))
    return df


def replace_literal(c: Column, query: str, replacement: str) -> tuple[Column, Column]:
    """(new text, number of replacements) for a literal, case-insensitive replace."""
    pattern = "(?iu)" + re.sub(r"([^\w\s])", r"\\\1", query)
    literal = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(c, pattern, literal), F.regexp_count(c, F.lit(pattern)).cast("long")

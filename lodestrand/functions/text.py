"""Text functions as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns, word lists and markers that results depend on.
WORD_PATTERN = r"[A-Za-z][A-Za-z0-9]*(?:[-_.][A-Za-z0-9]+)+|[A-Za-z]+|[0-9]+(?:\.[0-9]+)?"
PROTECTED_PATTERN = r"[A-Za-z][A-Za-z0-9]*(?:[-_.+][A-Za-z0-9]+)*|[0-9]+(?:\.[0-9]+)?%?"
SENTENCE_PATTERN = "[^.!?;。！？；]*[.!?;。！？；]+|[^.!?;。！？；]+$"
CJK_PATTERN = "[一-鿿]+"
CROSS_REFERENCE_PATTERN = r"(?i)\b(?:fig(?:ure)?|tab(?:le)?|eq(?:uation)?|sec(?:tion)?)\.?\s*(?:\(?[0-9]+(?:\.[0-9]+)*\)?|[IVXLCDM]+(?:\.[0-9]+)*)"
MOJIBAKE_PATTERN = "(?:�|Ã.|Â.){2,}"
FAILED_MARKERS = ("failed indexing", "indexing failed", "索引失败")
COUNT_MARKERS = ("how many papers", "how many documents", "论文数量", "多少篇", "几篇")
INVENTORY_MARKERS = ("list papers", "list all uploaded documents", "papers in database", "current database", "当前数据库", "当前知识库", "列出论文", "上传的文档")
EXPLICIT_MEMORY_PATTERN = (
    r"(?i)(?:^|[。！？\n])\s*(?:请(?:你)?|我(?:希望|想让)你)?(?:记住|以后|我的偏好是|后面统一|不要再)"
    r"|(?:^|[.!?\n])\s*(?:can you\s+)?(?:please\s+)?(?:remember\b|from now on\b|my preference is\b)"
)
EVIDENCE_MARKER_PATTERN = r"\[doc:[0-9]+\|page:|\[(?:E|chunk:)[0-9]+\]"
SECRET_URL_PATTERN = r"(?i)(?:[?&#]|%3f|%26)(?:api[_-]?key|token|authorization|access[_-]?token|apikey|auth)(?:=|%3d)"
SEARCH_WORD_PATTERN = r"[\p{L}\p{N}_.-]+"
ADVANCED_SEARCH_PATTERN = r"(?i)\b(?:AND|OR|ANDNOT)\b|\b(?:all|ti|au|abs|cat|id):"
KEPT_HYPHEN_PATTERN = r"(?i)\b([A-Za-z])-\r?\n(nearest|means|fold|value|space|NN)\b"
BROKEN_WORD_PATTERN = r"(?<=[A-Za-z])-\r?\n(?=[a-z])"
LINE_END_PATTERN = r"[ \t]*\r?\n[ \t]*"
VALUE = r"[^'\"\s,;}\]]+"
REDACTIONS = (
    (r"(?i)(['\"]?)(authorization)\1\s*([:=])(\s*)(['\"]?)(Bearer|Basic)\s+" + VALUE + r"\5", "$1$2$1$3$4$5$6 ***$5"),
    (r"(?i)(['\"]?)(api[_ -]?key|token)\1\s*([:=])\s*(['\"]?)(?:Bearer|Basic)\s+" + VALUE + r"\4", "$1$2$1$3$4***$4"),
    (r"(?i)(?<![\w-])sk-[A-Za-z0-9][A-Za-z0-9_.-]*", "sk-***"),
    (r"(?i)(['\"]?)(authorization)\1\s*([:=])(\s*)(['\"]?)(?!(?:Bearer|Basic)(?:\s|['\"]|$))" + VALUE + r"\5", "$1$2$1$3$4$5***$5"),
    (r"(?i)(['\"]?)(api[_ -]?key|token)\1\s*([:=])\s*(['\"]?)" + VALUE + r"\4", "$1$2$1$3$4***$4"),
)


#: The spaces that DuckDB's trim takes away: Unicode's category Zs.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _all(column: Column, pattern: str) -> Column:
    return F.regexp_extract_all(column, F.lit(pattern), F.lit(0))


def word_tokens(column: Column) -> Column:
    """Lower-case words and decimals in order, repeats kept; null gives none."""
    return F.transform(_all(F.coalesce(column, F.lit("")), WORD_PATTERN), lambda x: F.lower(x))


def query_terms(column: Column, n: int = 8) -> Column:
    """The first n distinct tokens of a question: the plan used when no planner answers."""
    return F.slice(F.array_distinct(word_tokens(column)), 1, n)


def trimmed(column: Column) -> Column:
    """Without the spaces of any script at either end."""
    return F.btrim(column, F.lit(SPACES))


def folded(column: Column) -> Column:
    """Lower case, a dotted capital I as a plain i."""
    return F.lower(F.replace(column, F.lit("\u0130"), F.lit("i")))


def squeeze(column: Column) -> Column:
    """White space as single spaces, trimmed."""
    return trimmed(F.regexp_replace(F.coalesce(column, F.lit("")), r"[ \t\n\r\f\x0B]+", " "))


def bounded(column: Column, n: int) -> Column:
    """Squeezed text of n characters at most."""
    return F.substring(squeeze(column), 1, n)


def ellipsis(column: Column, n: int) -> Column:
    """Text of n characters at most; a cut one ends in three dots after its first n - 1 without trailing space."""
    return F.when(F.length(column) <= n, column).otherwise(F.concat(F.rtrim(F.substring(column, 1, n - 1)), F.lit("...")))


def sentences(column: Column) -> Column:
    """Sentences with their terminators, trimmed, empty ones dropped."""
    return F.filter(F.transform(_all(F.coalesce(column, F.lit("")), SENTENCE_PATTERN), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def redact(column: Column) -> Column:
    """Secrets replaced by ***, by five patterns in their order."""
    for pattern, by in REDACTIONS:
        column = F.regexp_replace(column, pattern, by)
    return column


def operation(column: Column) -> Column:
    """What a question about the collection asks for, by its first family of markers."""
    folded = F.lower(squeeze(column))
    has = lambda markers: F.exists(F.array(*(F.contains(folded, F.lit(m)) for m in markers)), lambda x: x)
    return F.when(has(FAILED_MARKERS), "failed_indexing").when(has(COUNT_MARKERS), "count").when(has(INVENTORY_MARKERS), "inventory").otherwise("document_status")


def has_memory_intent(column: Column) -> Column:
    """Whether the writer asks for something to be remembered."""
    return F.coalesce(column, F.lit("")).rlike(EXPLICIT_MEMORY_PATTERN)


def has_cjk(column: Column) -> Column:
    return F.coalesce(column, F.lit("")).rlike(CJK_PATTERN)


def is_mojibake(column: Column) -> Column:
    return F.coalesce(column, F.lit("")).rlike(MOJIBAKE_PATTERN)


def protected_tokens(column: Column) -> Column:
    """Distinct tokens that a rewrite must keep: those with a digit or two capitals, lower-cased."""
    kept = F.filter(_all(F.coalesce(column, F.lit("")), PROTECTED_PATTERN), lambda x: x.rlike("[0-9]") | x.rlike("[A-Z].*[A-Z]"))
    return F.array_distinct(F.transform(kept, lambda x: F.lower(x)))


def cross_references(column: Column) -> Column:
    """Structs of reference text, type and canonical label."""
    def one(x: Column) -> Column:
        compact = F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"[.,;: ]+$", "")
        prefix = F.lower(F.regexp_extract(compact, r"^([A-Za-z]+)", 1))
        value = F.regexp_extract(compact, r"^[A-Za-z]+\.?\s*\(?(.+?)\)?$", 1)
        kind = F.when(prefix.startswith("fig"), "figure").when(prefix.startswith("tab"), "table").when(prefix.startswith("eq"), "equation").otherwise("section")
        label = F.when(kind == "figure", "Figure ").when(kind == "table", "Table ").when(kind == "equation", "Eq. ").otherwise("Section ")
        return F.struct(x.alias("text"), kind.alias("type"), F.concat(label, value).alias("label"))

    return F.transform(_all(F.coalesce(column, F.lit("")), CROSS_REFERENCE_PATTERN), one)


def heading_depth(column: Column) -> Column:
    """Depth of a dotted decimal or roman heading number; null without one."""
    t = squeeze(column)
    decimal = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)*)\.?\s+\S", 1)
    roman = F.regexp_extract(t, r"^([IVXLCDM]+)((?:\.[0-9]+)*)\.?\s+\S", 0)
    suffix = F.regexp_extract(t, r"^[IVXLCDM]+((?:\.[0-9]+)*)\.?\s+\S", 1)
    dots = lambda c: F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
    return F.when(decimal != "", dots(decimal) + 1).when(roman != "", dots(suffix) + 1)


def margin_text(column: Column) -> Column:
    """A margin line as compared between pages; a lone number is the page number."""
    return F.when(column.rlike(r"^\s*[0-9]+\s*$"), "<page-number>").otherwise(F.lower(squeeze(column)))


def join_lines(column: Column) -> Column:
    """Text of a printed page: hyphens of some terms kept over a line break, others joined, lines to one."""
    for pattern, by in ((KEPT_HYPHEN_PATTERN, "$1-$2"), (BROKEN_WORD_PATTERN, ""), (LINE_END_PATTERN, " ")):
        column = F.regexp_replace(column, pattern, by)
    return F.trim(column)


def evidence_text(column: Column) -> Column:
    """Letters and digits of a text in lower case, runs joined by one space."""
    return F.array_join(F.transform(_all(F.coalesce(column, F.lit("")), r"[\p{L}\p{N}]+"), lambda x: F.lower(x)), " ")


def slug(column: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def search_query(column: Column) -> Column:
    """Plain words as all:"w" joined by AND; an advanced query, or one without a word, passes trimmed."""
    clean = F.trim(column)
    plain = F.array_join(F.transform(_all(clean, SEARCH_WORD_PATTERN), lambda w: F.format_string('all:"%s"', w)), " AND ")
    return F.when(clean.rlike(ADVANCED_SEARCH_PATTERN), clean).otherwise(F.coalesce(F.nullif(plain, F.lit("")), clean))

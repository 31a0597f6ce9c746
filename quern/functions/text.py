"""

Java's regex classes are ASCII by default; patterns here say ``(?U)`` or spell Unicode classes out, so that ``\\s`` and
word characters mean what they mean for Unicode text. NFKC, structured references and odd HTML have no built-in form and
are pandas UDFs over the texts that need them; nothing else leaves the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import fixed

WORD = r"[\p{L}\p{N}_]"


def _java(pattern: str) -> str:
    return pattern.replace("W", WORD)


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """T1. Runs of white space become one space, ends are stripped; null becomes empty."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """Unicode NFKC form. Texts of ASCII characters, which have that form, don't go to Python."""
    return F.coalesce(_nfkc(F.when(~c.rlike(r"^\p{ASCII}*$"), c)), c)


def normalize(c: Column) -> Column:
    """T2. NFKC, punctuation to spaces, white space collapsed, lower case."""
    return F.lower(clean_text(F.regexp_replace(nfkc(c), r"(?U)[^\p{L}\p{N}_\s]", " ")))


def normalize_light(c: Column) -> Column:
    """T3. NFKC, white space collapsed."""
    return clean_text(nfkc(c))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def expand_abbreviations(c: Column) -> Column:
    """T4. Whole words that are abbreviations of legal terms, in any case, become the terms."""
    runs = F.regexp_extract_all(c, F.lit(f"({WORD}+|[^\\p{{L}}\\p{{N}}_]+)"), F.lit(1))
    known = _map(fixed.LEGAL_TERMS)
    return F.array_join(F.transform(runs, lambda w: F.coalesce(F.element_at(known, F.lower(w)), w)), "")


def prepare_for_bm25(c: Column) -> Column:
    """T5. T4 of T2."""
    return expand_abbreviations(normalize(c))


def prepare_query(c: Column) -> Column:
    """T33. T4 of T3."""
    return expand_abbreviations(normalize_light(c))


def words(c: Column) -> Column:
    """White-space-separated words; none for an empty text."""
    return F.filter(F.split(clean_text(c), " "), lambda w: w != "")


def remove_stop_words(tokens: Column) -> Column:
    """T7. Repeated tokens stay repeated."""
    return F.filter(tokens, lambda w: ~w.isin(fixed.STOP_WORDS))


def tokenize(c: Column, segment=None) -> Column:
    """T6, T8. Words of T5 without stop words; ``segment`` (a column function) may replace the split at spaces."""
    return remove_stop_words((segment or words)(prepare_for_bm25(c)))


def terms(c: Column) -> Column:
    """Search terms: lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD}{{2,}})"), F.lit(1))


def doc_code(c: Column) -> Column:
    """T9. The first form of a document code, in order of priority, that is found anywhere."""
    return F.coalesce(*(F.nullif(F.regexp_extract(c, f"({_java(p)})", 1), F.lit("")) for p in fixed.DOC_CODES), F.lit(""))


REFERENCE = "array<struct<type:string,value:string,match:string>>"


def _reference(kind: str):
    return lambda m, v: F.struct(F.lit(kind).alias("type"), strip(v).alias("value"), m.alias("match"))


def references(c: Column) -> Column:
    """T10. References (type, value, match), by type and then position."""
    parts = []
    for kind, pattern in fixed.REFERENCES.items():
        p = f"(?U){_java(pattern)}"
        whole, value = (F.regexp_extract_all(c, F.lit(p), F.lit(g)) for g in (0, 1))
        parts.append(F.zip_with(whole, value, _reference(kind)))
    return F.coalesce(F.concat(*parts), F.array().cast(REFERENCE))


_PAIR, _ARTICLE, _CLAUSE = re.compile(r"Điều\s+(\d+)\s+Khoản\s+(\d+)"), re.compile(r"Điều\s+(\d+)"), re.compile(r"Khoản\s+(\d+)")
#: A clause on its own belongs to the last article unless an article stands so many characters before it.
_LOOK_BACK = 20


def _structured(text: str | None) -> list[dict]:
    if not text:
        return []
    pairs: dict[tuple[str, str], re.Match] = {}
    for m in _PAIR.finditer(text):
        pairs.setdefault((m[1], m[2]), m)
    # a pair that comes again is an article of its own and a clause
    inside = lambda at: any(m.start() <= at < m.end() for m in pairs.values())
    articles = [m for m in _ARTICLE.finditer(text) if not inside(m.start())]
    keys = [*pairs, *((m[1], "") for m in articles)]
    for m in _CLAUSE.finditer(text):
        if not inside(m.start()) and articles and not _ARTICLE.search(text, max(0, m.start() - _LOOK_BACK), m.start()):
            keys.append((articles[-1][1], m[1]))
    with_clause = {a for a, c in keys if c}
    return [{"type": "article_clause" if c else "article", "article_id": a, "clause_id": c} for a, c in dict.fromkeys(keys) if c or a not in with_clause]


STRUCTURED = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("type", "article_id", "clause_id")]))


@F.pandas_udf(STRUCTURED)
def _structured_references(texts: pd.Series) -> pd.Series:
    return texts.map(_structured)


def structured_references(c: Column) -> Column:
    """T11. Articles and (article, clause) pairs; articles with a clause elsewhere are left out. Only texts that name a
    clause go to Python."""
    alone = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)Điều\s+(\d+)"), F.lit(1)))
    plain = F.transform(alone, lambda a: F.struct(F.lit("article").alias("type"), a.alias("article_id"), F.lit("").alias("clause_id")))
    with_clause = F.contains(c, F.lit("Khoản"))
    return F.when(with_clause, _structured_references(F.when(with_clause, c))).otherwise(F.coalesce(plain, F.array().cast(STRUCTURED)))


class _TextNodes(HTMLParser):
    """The text nodes of HTML, without those of scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.found.append("")

    def handle_startendtag(self, tag, attrs):
        self.found.append("")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1
        self.found.append("")

    def handle_comment(self, data):
        self.found.append("")

    handle_decl = unknown_decl = handle_pi = handle_comment

    def handle_data(self, data):
        if not self.hidden:
            # entities may split a node; what lies between two tags is one
            self.found[-1:] = [self.found[-1] + data] if self.found else [data]


def _parsed_html(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _TextNodes()
    parser.feed(html)
    parser.close()
    return "\n".join(x for x in parser.found if x)


@F.pandas_udf(T.StringType())
def _text_nodes(texts: pd.Series) -> pd.Series:
    return texts.map(_parsed_html)


#: Entities that expressions decode, the ampersand last; markup with others is parsed.
ENTITIES = {"nbsp": "\u00a0", "copy": "©", "middot": "·", "reg": "®", "ndash": "–", "mdash": "—", "hellip": "…", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "amp": "&"}
#: What holds no text: scripts, styles, comments, the document's type.
HIDDEN = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->|<!doctype[^>]*>"
#: A tag without brackets in its quoted attributes.
TAG = r"""<[A-Za-z/](?:[^"'<>]|"[^"<>]*"|'[^'<>]*')*>"""
_OTHER_ENTITY = rf"&(?!(?:{'|'.join(ENTITIES)});)[A-Za-z#]"


#: An ampersand that starts no closed reference.
_UNCLOSED = r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)"


def html_text(c: Column, unclosed: bool = True) -> Column:
    """T12. Text of HTML: what lies between tags, one line each, without scripts, styles and comments; entities are decoded,
    an article's mark is joined with the sign behind it, blanks and blank lines shrink.

    Plain markup is handled by expressions. Texts with other entities, or with a bracket that is in no plain tag, go to a
    parser in Python. Entities without their semicolon are decoded too (``&amp`` at the end of a cut title), unless
    ``unclosed`` says that they stay as they stand.
    """
    if not unclosed:
        c = F.regexp_replace(c, _UNCLOSED, "&amp;")
    plain = F.regexp_replace(c, HIDDEN, "<x>")
    odd = F.coalesce(F.contains(F.regexp_replace(plain, TAG, ""), F.lit("<")) | plain.rlike(_OTHER_ENTITY), F.lit(False))
    t = F.regexp_replace(plain, f"(?:{TAG})+", "\n")
    for entity, char in ENTITIES.items():
        t = F.replace(t, F.lit(f"&{entity};"), F.lit(char))
    t = F.when(odd, _text_nodes(F.when(odd, c))).otherwise(t)
    t = F.replace(F.regexp_replace(t, r"(?U)(Điều\s+\d+)\s*\n\s*([.:])", "$1$2"), F.lit("\u00a0"), F.lit(" "))
    return strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def capital_title(c: Column) -> Column:
    """T13. The first all-capital line of more than 20 characters that is no heading; empty without one."""
    lines = F.transform(F.split(c, "\n"), strip)
    ok = F.filter(lines, lambda x: (F.length(x) > 20) & (F.upper(x) == x) & (F.lower(x) != x) & ~x.rlike(fixed.HEADINGS))
    return F.coalesce(F.try_element_at(ok, F.lit(1)), F.lit(""))


def clean_title(c: Column) -> Column:
    """T14. Without a final article mark."""
    return strip(F.regexp_replace(c, rf"(?U)\s*-\s*Điều\s+{WORD}+.*$", ""))


def index_title(c: Column) -> Column:
    """T16. Without a final numbered article mark."""
    return F.regexp_replace(c, r"(?U)\s*-\s*Điều\s+\d+\s*$", "")


def format_article(c: Column) -> Column:
    """T15. The article's mark before its number, once."""
    return F.when(F.coalesce(c, F.lit("")) == "", "").when(F.contains(F.lower(c), F.lit("điều")), c).otherwise(F.concat(F.lit("Điều "), c))


def short_name(c: Column) -> Column:
    """T17. A title without its code and then its leading type."""
    t = strip(F.regexp_replace(c, r"\d+/\d{4}/\S+\s*", ""))
    return strip(F.regexp_replace(t, rf"^({'|'.join(fixed.TITLE_TYPES)})\s+", ""))


def expand_law_names(c: Column) -> Column:
    """T18. Abbreviations in law names, one after the other."""
    for short, full in fixed.LAW_NAME_TERMS.items():
        c = F.regexp_replace(c, rf"(?<!{WORD}){short}(?!{WORD})", full)
    return c


def law_kind(c: Column) -> Column:
    """T19. The kind of law that a lower-cased name starts with; empty without one."""
    return F.regexp_extract(c, rf"^\s*({'|'.join(fixed.LAW_KINDS)})(?!{WORD})", 1)


def kinds_compatible(asked: Column, title: Column) -> Column:
    """T20. A title without a kind fits; laws and codes of law fit each other; others must be equal."""
    law = ["luật", "bộ luật"]
    return (title == "") | (asked == title) | (asked.isin(law) & title.isin(law))


def core_name(c: Column) -> Column:
    """T21. A lower-cased name without kind, years, codes and punctuation."""
    t = F.regexp_replace(c, rf"^\s*({'|'.join(fixed.NAME_TYPES)})\s+", "")
    t = F.regexp_replace(t, rf"(?<!{WORD})\d{{4}}(?!{WORD})", "")
    t = F.regexp_replace(t, r"\d+/\d+/\S+", "")
    return clean_text(F.regexp_replace(t, r"(?U)[^\p{L}\p{N}_\s]+", " "))


def year(c: Column) -> Column:
    """T22. The first year from 1900 to 2099; empty without one."""
    return F.regexp_extract(c, rf"(?<!{WORD})((19|20)\d{{2}})(?!{WORD})", 1)


def parse_json(c: Column, schema: str) -> Column:
    """T23. The JSON object of a model's reply: of a fenced block, of the whole, or between the outermost braces."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    valid = [F.when(F.get_json_object(x, "$").isNotNull(), x) for x in (strip(fenced), strip(c), braces)]
    return F.from_json(F.coalesce(*valid, F.lit("{}")), schema)


def bullets(c: Column) -> Column:
    """T24. Lines that start with a dash, without dashes and spaces in front, if longer than five characters."""
    lines = F.transform(F.split(c, "\n"), strip)
    own = F.filter(lines, lambda x: F.startswith(x, F.lit("-")))
    return F.filter(F.transform(own, lambda x: strip(F.regexp_replace(x, "^[- ]+", ""))), lambda x: F.length(x) > 5)


def label_of(c: Column, labels: list[str], default: str) -> Column:
    """T25. The first label that the lower-cased reply contains."""
    return F.coalesce(*(F.when(F.contains(F.lower(c), F.lit(x)), F.lit(x)) for x in labels), F.lit(default))


def number_list(c: Column, bound: Column | int) -> Column:
    """T26. 0-based positions named by a 1-based comma-separated list, within bounds, each once, ascending."""
    n = F.transform(F.split(c, ","), lambda x: F.when(strip(x).rlike("^[0-9]+$"), strip(x)).try_cast("int") - 1)
    return F.array_sort(F.array_distinct(F.filter(n, lambda x: x.isNotNull() & (x >= 0) & (x < (F.lit(bound) if isinstance(bound, int) else bound)))))


def truncate_at_word(c: Column, most: int = 2048, least: int = 1800) -> Column:
    """T27. The first ``most`` characters, cut at their last space if it lies beyond ``least``."""
    head = F.substring(c, 1, most)
    space = F.length(head) - F.locate(" ", F.reverse(head))  # 0-based place of the last space
    return F.when(F.length(c) <= most, c).when((F.locate(" ", head) > 0) & (space > least), F.substring(head, F.lit(1), space)).otherwise(head)


def prompt_query(c: Column, instruction: str) -> Column:
    """T28. A query with the instruction that an embedding model expects."""
    return F.concat(F.lit(f"{instruction}\nTruy vấn: "), c)


def corpus_id(code: Column, article: Column) -> Column:
    """T29. ``code#article``; null unless both are full."""
    return F.when((F.coalesce(code, F.lit("")) != "") & (F.coalesce(article, F.lit("")) != ""), F.concat(code, F.lit("#"), article))


def stable_number(c: Column, below: int = 100_000) -> Column:
    """T31. A number for a text id, equal in every process."""
    return F.pmod(F.xxhash64(c), F.lit(below))


def key_part(c: Column, at: int = 1) -> Column:
    """T32. A part of a key joined by bars."""
    return F.split_part(c, F.lit("|"), F.lit(at))

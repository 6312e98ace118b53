"""Text normalisation as Column expressions.

Everything stays in the JVM. Accent folding covers the Latin letters by a
translation table built from the Unicode database; gleaner.functions.unicode has
exact forms for every script.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and word characters, which Java's \s and \w don't cover.
WS, NOT_WS = r"[\s\p{Z}\x1C-\x1F\x85]", r"[^\s\p{Z}\x1C-\x1F\x85]"
WORD = r"[\p{L}\p{N}_]"
START, END = rf"(?<!{WORD})", rf"(?!{WORD})"

# The behaviour to match is defined by these lists.
ABBREVIATIONS = [
    ("dh", "dai hoc"),
    ("thpt", "trung hoc pho thong"),
    ("thcs", "trung hoc co so"),
    ("sv", "sinh vien"),
    ("gv", "giao vien"),
    ("bai tap", "bai tap"),
    ("pt", "phuong trinh"),
    ("bpt", "bat phuong trinh"),
    ("bđt", "bat dang thuc"),
]
PROTECTED = [
    ("ts.", "ts<dot>"),
    ("ths.", "ths<dot>"),
    ("p.gs.", "pgs<dot>"),
    ("tp.hcm", "tphcm"),
    ("vd.", "vd<dot>"),
    ("v.d.", "vd<dot>"),
    ("v.v.", "vv<dot>"),
]
STOP_WORDS = ["la", "va", "hoac", "voi", "cua", "cho", "trong", "neu", "thi", "tai", "duoc", "khong", "mot", "nhung", "nhieu", "cac", "nhu", "ve", "theo", "tu", "den", "de", "hay", "roi"]
INTENTS = [
    ("definition", "dinh nghia|la gi|khai niem"),
    ("proof", "chung minh|vi sao|giai thich"),
    ("procedure", "cach lam|quy trinh|cac buoc|huong dan"),
    ("comparison", "so sanh|khac nhau|giong nhau|doi chieu"),
    ("example", "vi du|bai tap|minh hoa"),
]
KEYWORDS = [
    ("dinh nghia", ["dinh nghia", "khai niem"]),
    ("dinh ly", ["dinh ly", "bo de", "he qua"]),
    ("chung minh", ["chung minh", "proof"]),
    ("vi du", ["vi du", "minh hoa"]),
    ("cau hoi", ["cau hoi", "bai tap"]),
    ("loi giai", ["loi giai", "dap an"]),
]
SUBJECTS = [
    ("toan", ["toan", "dai so", "hinh hoc"]),
    ("vat ly", ["vat ly", "ly"]),
    ("hoa hoc", ["hoa", "hoa hoc"]),
    ("sinh hoc", ["sinh", "sinh hoc"]),
    ("ngu van", ["van", "ngu van"]),
    ("lich su", ["lich su", "su hoc"]),
    ("dia ly", ["dia ly", "dia"]),
    ("tin hoc", ["tin hoc", "lap trinh"]),
    ("tieng anh", ["tieng anh", "english"]),
]
SLIDE_HINTS = ["slide", "slides", "lecture", "bai_giang", "ppt"]
BOOK_HINTS = ["book", "textbook", "chapter", "sach", "chuong"]
HEADING = r"^(?:#{1,6}\s+|chuong\s+\d+|chapter\s+\d+|muc\s+\d+|section\s+\d+|\d+(?:\.\d+){0,3}\s+)"
CLARIFY = {
    "definition": "Ban dang can dinh nghia theo mon/lop/chuong nao?",
    "proof": "Ban can chung minh theo tai lieu nao (mon/lop/chuong)?",
    "procedure": "Ban muon quy trinh trong chuong nao hoac bo bai nao?",
    "comparison": "Ban can so sanh hai khai niem nao, thuoc tai lieu nao?",
    "example": "Ban can vi du thuoc mon/lop/chuong nao?",
    "general": "Ban co the cho biet mon, lop, chuong hoac ten tai lieu cu the duoc khong?",
}
CLARIFY_HEAD = "Do tin cay retrieval hien dang thap nen minh chua tra loi de tranh sai. "


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sub(c: Column | str, pattern: str, to: str) -> Column:
    return F.regexp_replace(col(c), F.lit(pattern), F.lit(to))


def strip(c: Column | str) -> Column:
    return sub(c, rf"^{WS}+|{WS}+$", "")


def once(c: Column | str, make: Callable[[Column], Column]) -> Column:
    """make(c), with c worked out once for a row. A Column that is named in
    several branches is otherwise copied into each of them."""
    return F.get(F.transform(F.array(col(c)), make), F.lit(0))


def any_of(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


@cache
def accents() -> tuple[str, str]:
    """Latin letters that decompose to one letter and marks, and that letter."""
    found = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        bare = [ch for ch in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(ch)]
        if len(bare) == 1 and bare[0] != chr(code):
            found[chr(code)] = bare[0]
    return "".join(found), "".join(found.values())


def strip_diacritics(c: Column | str) -> Column:
    """T1 for Latin text: letters lose their marks; loose marks go."""
    letters, bare = accents()
    return sub(F.translate(col(c), letters, bare), r"\p{Mn}+", "")


def normalize_whitespace(c: Column | str) -> Column:
    """T2"""
    return strip(sub(sub(F.translate(col(c), "\u00a0", " "), r"[ \t]{2,}|\t", " "), r"\n{3,}", "\n\n"))


@cache
def folds() -> tuple[str, str]:
    """Letters that fold to another single letter than their lower case, and that
    letter (the final sigma, the long s, ...)."""
    found = {}
    for code in range(0xA0, 0x10000):
        low = chr(code).lower()
        if not 0xD800 <= code < 0xE000 and len(low) == 1 and low.casefold() != low and len(low.casefold()) == 1:
            found[low] = low.casefold()
    return "".join(found), "".join(found.values())


def casefold(c: Column | str) -> Column:
    """Case folding but for letters, other than ß, that fold to several"""
    return F.translate(F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss")), *folds())


def match_text(c: Column | str, keep_diacritics: bool = True) -> Column:
    """T3"""
    out = casefold(normalize_whitespace(c))
    if not keep_diacritics:
        out = strip_diacritics(out)
    return strip(sub(out, r"[\s\p{Z}\x1C-\x1F\x85\u200B]+", " "))


def fix_ocr(c: Column | str) -> Column:
    """T4"""
    out = sub(c, r"(?<=\p{Nd})[lI](?=\p{Nd})", "1")
    out = sub(out, r"(?<=\p{Nd})[oO](?=\p{Nd})", "0")
    out = sub(out, rf"{START}rn(?={WORD})", "m")
    out = sub(out, rf"{WS}+([,.;:!?])", "$1")
    out = sub(out, rf"([,.;:!?])({NOT_WS})", "$1 $2")
    return normalize_whitespace(sub(out, rf"{WS}{{2,}}", " "))


def clean_text(c: Column | str) -> Column:
    """T5; paragraph breaks go, as T4 joins runs of white space"""
    return strip(fix_ocr(normalize_whitespace(F.translate(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), "\r", "\n"))))


def expand_abbreviations(c: Column | str) -> Column:
    """T6"""
    out = F.concat(F.lit(" "), col(c), F.lit(" "))
    for short, full in ABBREVIATIONS:
        out = sub(out, rf"(?iu){START}{short}{END}", full)
    return F.when(col(c) == "", F.lit("")).otherwise(normalize_whitespace(out))


def tokens(c: Column | str, drop_stop_words: bool = False, keep_diacritics: bool = True) -> Column:
    """T7"""
    found = F.filter(F.regexp_extract_all(match_text(c, keep_diacritics), F.lit(rf"{WORD}+"), F.lit(0)), lambda t: F.length(t) > 1)
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS)) if drop_stop_words else found


def terms(c: Column | str) -> Column:
    """Tokens without accents and stop words, as search uses them."""
    return tokens(c, drop_stop_words=True, keep_diacritics=False)


def sentences(c: Column | str) -> Column:
    """T8"""
    raw = normalize_whitespace(c)
    hidden = reduce(lambda a, p: F.replace(a, F.lit(p[0]), F.lit(p[1])), PROTECTED, raw)
    parts = F.filter(F.transform(F.split(hidden, rf"(?<=[.!?]){WS}+", -1), strip), lambda x: x != "")
    return F.transform(parts, lambda x: reduce(lambda a, p: F.replace(a, F.lit(p[1]), F.lit(p[0])), PROTECTED, x))


def token_count(c: Column | str) -> Column:
    """T10"""
    marks = F.regexp_count(col(c), F.lit(r"[.,;:!?()\[\]{}]"))
    return F.when(col(c) == "", F.lit(0)).otherwise(F.regexp_count(col(c), F.lit(rf"{WORD}+")) + F.greatest(F.lit(1), F.floor(marks / 2))).cast("long")


def keywords(c: Column | str) -> Column:
    """T11"""
    found = lambda text: F.array(*[F.when(any_of(text, variants), F.lit(label)) for label, variants in KEYWORDS])
    return F.array_compact(once(match_text(c, keep_diacritics=False), found))


def intent(c: Column | str) -> Column:
    """T12"""

    def first(text: Column) -> Column:
        out = F.lit("general")
        for label, phrases in reversed(INTENTS):
            out = F.when(text.rlike(rf"{START}(?:{phrases}){END}"), F.lit(label)).otherwise(out)
        return out

    return once(match_text(c, keep_diacritics=False), first)


def metadata(name: Column | str, text: Column | str) -> Column:
    """T13 as a struct"""
    trimmed = strip(name)
    expanded = expand_abbreviations(match_text(trimmed, keep_diacritics=False))
    line = normalize_whitespace(F.split_part(col(text), F.lit("\n"), F.lit(1)))
    fits = (strip(text) != "") & F.length(line).between(4, 180)
    subject = F.lit("")
    for label, hints in reversed(SUBJECTS):
        subject = F.when(any_of(expanded, hints), F.lit(label)).otherwise(subject)
    grade = F.regexp_extract(expanded, rf"(?i){START}(?:lop|grade){WS}*([1-9]|1[0-2]){END}", 1)
    chapter = F.regexp_extract(expanded, rf"(?i){START}(?:chuong|chapter|phan|muc|section){WS}*([0-9]{{1,2}}[a-z]?){END}", 1)
    return F.struct(
        strip(F.when(fits, line).otherwise(trimmed)).alias("title"),
        subject.alias("subject"),
        F.when(grade != "", F.concat(F.lit("Lop "), grade)).otherwise("").alias("grade"),
        F.when(chapter != "", F.concat(F.lit("Chuong "), chapter)).otherwise("").alias("chapter"),
        F.regexp_extract(expanded, rf"{START}(19\d{{2}}|20\d{{2}}){END}", 1).alias("published_year"),
        trimmed.alias("source"),
    )


def context_header(subject: Column, grade: Column, chapter: Column, section: Column, page: Column) -> Column:
    """T14"""
    parts = [F.when(strip(c) != "", strip(c)) for c in (subject, grade, chapter, section)]
    return F.concat_ws(" · ", *parts, F.when(page > 0, F.concat(F.lit("Trang "), page.cast("string"))))


def query_variants(c: Column | str) -> Column:
    """Up to four distinct wordings of a query, in order"""
    base = normalize_whitespace(c)
    bare = match_text(base, keep_diacritics=False)
    expanded = expand_abbreviations(bare)
    focus = F.array_join(terms(expanded), " ")
    found = F.array_distinct(F.filter(F.array(base, match_text(base), bare, expanded, focus), lambda x: x != ""))
    return F.when(base == "", F.array().cast("array<string>")).otherwise(F.slice(found, 1, 4))


def document_type(name: Column | str, extension: Column | str) -> Column:
    """T16"""
    low, kind = F.lower(strip(name)), F.lower(strip(extension))
    return F.when(kind.isin(".ppt", ".pptx") | any_of(low, SLIDE_HINTS), "slide").when(any_of(low, BOOK_HINTS) | (kind == ".pdf"), "book").otherwise("note")


def is_heading(c: Column | str) -> Column:
    """T17"""
    return col(c).rlike("(?i)" + HEADING.replace(r"\s", WS).replace(r"\d", r"\p{Nd}"))


def is_question(c: Column | str) -> Column:
    return casefold(c).startswith("cau hoi") | casefold(c).startswith("question")


def is_answer(c: Column | str) -> Column:
    return casefold(c).startswith("loi giai") | casefold(c).startswith("dap an") | casefold(c).startswith("answer")


def is_protected(c: Column | str) -> Column:
    """T19"""
    return col(c).contains("\n- ") | col(c).contains("\n* ") | is_question(c) | is_answer(c) | col(c).rlike(r"[=<>^]")


def section_path(chapter: Column | str, section: Column | str) -> Column:
    """T20"""
    a, b = clean_text(chapter), clean_text(section)
    both = (a != "") & (b != "") & (casefold(a) != casefold(b))
    return F.when(both, F.concat_ws(" > ", a, b)).when(b != "", b).otherwise(a)


def strip_hashes(c: Column) -> Column:
    return strip(sub(c, rf"^#{{1,6}}{WS}*", ""))


def parent_title(text: Column | str, section: Column | str, longest: int = 120) -> Column:
    """T21"""
    hint = clean_text(section)
    line = clean_text(F.split_part(col(text), F.lit("\n"), F.lit(1)))
    first = F.when(is_heading(line), strip_hashes(line)).otherwise(F.coalesce(F.get(sentences(line), F.lit(0)), line))
    title = F.when((hint != "") & ~casefold(hint).isin("section", "chuong", "chapter"), hint).otherwise(first)
    return F.when(title == "", "Section").when(F.length(title) <= longest, title).otherwise(F.concat(sub(F.substring(title, 1, longest - 3), rf"{WS}+$", ""), F.lit("...")))


def trim_summary(c: Column | str, longest: int = 280) -> Column:
    """T23"""
    flat = strip(sub(c, rf"{WS}+", " "))
    return F.when(F.length(flat) <= longest, flat).otherwise(F.concat(sub(F.substring(flat, 1, longest), rf"{WS}+$", ""), F.lit("...")))


def e5_prefix(c: Column | str, model: str, kind: str) -> Column:
    """T24; kind: query or passage"""
    low = model.lower()
    return F.concat(F.lit(f"{kind}: "), col(c)) if "multilingual-e5" in low or "e5-" in low or low.endswith("e5-large") else col(c)


def sentence_overlap(c: Column | str, count: int = 2) -> Column:
    """C7"""
    found = sentences(c)
    if count <= 0:
        return F.lit("")
    last = F.slice(found, -F.least(F.lit(count), F.size(found)), F.lit(count))
    return F.when(F.size(found) <= 1, "").otherwise(clean_text(F.array_join(last, " ")))


def clarification(c: Column | str) -> Column:
    """the text that asks back, by intent"""

    def asked(intent: Column) -> Column:
        out = F.lit(CLARIFY["general"])
        for label, text in CLARIFY.items():
            out = F.when(intent == label, F.lit(text)).otherwise(out)
        return out

    return F.concat(F.lit(CLARIFY_HEAD), once(c, asked))


def lexical_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two term arrays"""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)

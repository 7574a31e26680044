"""Text functions as column expressions: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CJK = r"[一-鿿]"
REFUSAL_MARKERS = ["未找到", "没有找到", "资料中未", "无法回答", "not found", "No relevant", "无法从"]
SYSTEM_REFUSAL = r"^\s*资料中未找到与该问题相关的内容（最高置信度\s*\d+\.\d{2}）"
EMPTY_BASE = r"^\s*知识库为空"
LEADING_REFUSAL = r"(?i)^\s*(资料中未找到[^。]*。|未找到[^。]*。|没有找到[^。]*。|无法回答[^。]*。|无法从[^。]*。|not found[^.]*\.)"
MARKUP_NOISE = r"[*_`#>\[\]()\-•·\s]+"
MIN_REDIRECT_CHARS = 12
EXPANSIONS = {
    "装备": ["登山鞋", "速干衣", "头灯", "水壶", "外套"],
    "equipment": ["hiking shoes", "tent", "stove", "water bottle"],
    "what": [],
    "合同": ["条款", "金额", "违约", "延期", "签约"],
    "contract": ["clause", "amount", "penalty", "deadline"],
    "上线": ["发布", "日期", "版本", "发布日"],
    "launch": ["release", "date", "version", "ship"],
    "API": ["调用", "endpoint", "key", "认证"],
    "金额": ["总价", "签约金", "费用", "支付"],
    "amount": ["total", "fee", "price", "payment"],
}
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"  # what (?U)\s matches
PAGE_LINE = r"(?i)^\s*\d+\s*$|^\s*page\s*\d+|^\s*\d+\s*/\s*\d+\s*$"


def stripped(x: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.trim(x, F.lit(WHITE_SPACE))


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _bigrams(ideographs: Column) -> Column:
    starts = F.sequence(F.lit(1), F.length(ideographs) - 1)
    return F.when(F.length(ideographs) >= 2, F.transform(starts, lambda i: F.substring(ideographs, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def lowered(text: Column | str) -> Column:
    """A text in lower case, null as empty."""
    return F.lower(_text(text))


def search_tokens(text: Column | str) -> Column:
    """Lower-case ASCII words, then every ideograph, then the bigrams of all ideographs as one string; repeats stay."""
    low = lowered(text)
    words = F.regexp_extract_all(low, F.lit("([a-z0-9_]+)"), F.lit(1))
    ideographs = F.regexp_replace(low, r"[^一-鿿]", "")
    singles = F.filter(F.split(ideographs, ""), lambda c: c != "")
    return F.concat(words, singles, _bigrams(ideographs))


def memory_tokens(text: Column | str) -> Column:
    """Distinct lower-case words of letters and digits, and ideograph bigrams."""
    low = F.lower(_text(text))
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1)), _bigrams(F.regexp_replace(low, r"[^一-鿿]", ""))))


def outline(markdown: Column | str) -> Column:
    """Headings of a Markdown text in order: level, title and line (from 1)."""
    lines = F.split(_text(markdown), "\n")
    rows = F.transform(lines, lambda line, i: F.struct(F.length(F.regexp_extract(line, r"^(#{1,6})\s+(.+)$", 1)).alias("level"), F.trim(F.regexp_extract(line, r"^(#{1,6})\s+(.+)$", 2)).alias("title"), (i + 1).alias("line")))
    return F.filter(rows, lambda h: h.level > 0)


def heading_at(headings: Column, line: Column) -> Column:
    """The last heading that begins at or before ``line``; null if there is none."""
    before = F.filter(headings, lambda h: h.line <= line)
    return F.when(F.size(before) > 0, F.element_at(before, -1))


def lines_around(text: Column | str, line: Column, context: Column | int) -> Column:
    """Lines ``line - context`` to ``line + context`` of a text, joined."""
    around = context if isinstance(context, Column) else F.lit(context)
    lines = F.split(_text(text), "\n")
    start = F.greatest(F.lit(1), line - around)
    count = F.least(F.size(lines), line + around) - start + 1
    return F.when(count > 0, F.array_join(F.slice(lines, start, F.greatest(count, F.lit(0))), "\n")).otherwise(F.lit(""))


def keyword_hits(text: Column, keywords: Column) -> Column:
    """How many keywords stand in a text, whatever the case."""
    low = F.lower(_text(text))
    return F.size(F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.contains(low, F.lower(k))))


def has_refusal_marker(answer: Column | str) -> Column:
    text = _text(answer)
    return F.exists(F.array(*[F.lit(m) for m in REFUSAL_MARKERS]), lambda m: F.contains(text, m))


def after_leading_refusal(answer: Column | str) -> Column:
    """What is left of an answer behind a refusal in its first sentence."""
    return F.regexp_replace(_text(answer), LEADING_REFUSAL, "")


def has_substance(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"(?U){MARKUP_NOISE}", "")) >= MIN_REDIRECT_CHARS


def answer_state(answer: Column | str, confidence: Column, expect_reject: Column, keywords: Column, threshold: float = 0.30) -> Column:
    """SYSTEM_REFUSE, REFUSED, REDIRECTED or DELIVERED."""
    text = _text(answer)
    found = F.exists(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: (F.length(k) > 0) & F.contains(F.lower(text), F.lower(k)))
    delivered = F.when(F.coalesce(expect_reject, F.lit(False)), ~has_refusal_marker(text)).otherwise(F.coalesce(found, F.lit(False)))
    return (
        F.when(confidence < threshold, "SYSTEM_REFUSE")
        .when(text.rlike(EMPTY_BASE) | text.rlike(SYSTEM_REFUSAL), "SYSTEM_REFUSE")
        .when(~text.rlike(r"(?U)\S"), "REFUSED")
        .when(delivered, "DELIVERED")
        .when(has_substance(after_leading_refusal(text)), "REDIRECTED")
        .otherwise("REFUSED")
    )


def clean_page_text(text: Column | str) -> Column:
    """Lines without blanks, page numbers and running heads; a line behind a hyphen goes on with the next one."""
    lines = F.transform(F.split(_text(text), "\n"), stripped)
    begun = list("0123456789pP")  # as a page line does, which is asked first as it is cheap
    kept = F.filter(lines, lambda line: (line != "") & ~(F.substring(line, 1, 1).isin(begun) & line.rlike(PAGE_LINE)))
    return F.replace(F.array_join(kept, "\n"), F.lit("-\n"), F.lit(""))


def infer_title(text: Column | str, within: int = 500, longest: int = 80) -> Column:
    """The first top heading, or the first other short line, at the beginning of a text."""
    lines = F.transform(F.split(F.substring(_text(text), 1, within), "\n"), lambda x: F.trim(x))
    titles = F.transform(F.filter(lines, lambda x: x.startswith("# ") | ((x != "") & ~x.startswith("#") & (F.length(x) <= longest))), lambda x: F.when(x.startswith("# "), F.trim(F.regexp_replace(x, "^# ", ""))).otherwise(x))
    return F.coalesce(F.get(titles, F.lit(0)), F.lit(""))


def unfenced(text: Column | str) -> Column:
    """The inside of a fenced block, or the text."""
    return stripped(F.regexp_replace(F.regexp_replace(stripped(_text(text)), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def numbered_part(text: Column | str, n: Column) -> Column:
    """Part ``n`` of a reply whose parts stand behind lines like ``--- 第2段 ---``."""
    marks = F.split(_text(text), r"---\s*第\d+段\s*---")
    order = F.transform(F.regexp_extract_all(_text(text), F.lit(r"---\s*第(\d+)段\s*---"), F.lit(1)), lambda x: x.cast("int"))
    at = F.array_position(order, n)
    return F.when(at > 0, stripped(F.element_at(marks, (at + 1).cast("int"))))


def rewritten_variants(reply: Column | str, question: Column, most: int = 3) -> Column:
    """The question, then the lines of a model's reply without bullets and numbers, without blanks and the question itself."""
    lines = F.transform(F.split(_text(reply), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[\-\*\d]+[.\):\s]+", "")))
    return F.concat(F.array(question), F.slice(F.filter(lines, lambda x: (x != "") & (x != question)), 1, most))


def expanded_variants(question: Column, most: int = 3) -> Column:
    """The question, then variants in which a vague word is replaced by a term that goes with it.

    A word counts whatever its case, but is replaced only as it is written; the word that brings the number of variants
    to ``most`` is the last one used.
    """
    none = F.array().cast("array<string>")
    steps = []
    for word, terms in EXPANSIONS.items():
        at = F.instr(question, word)
        new = [F.when(at > 0, F.concat(F.substring(question, F.lit(1), at - 1), F.lit(t), F.substring(question, at + len(word), F.length(question)))) for t in terms[:2]]
        if new:
            steps.append(F.struct(F.contains(F.lower(question), F.lit(word.lower())).alias("met"), F.filter(F.array(*new), lambda v: v.isNotNull() & (v != question)).alias("fresh")))
    variants = F.aggregate(F.array(*steps), none, lambda out, s: F.when((F.size(out) < most) & s.met, F.array_distinct(F.concat(out, s.fresh))).otherwise(out))
    return F.concat(F.array(question), F.slice(variants, 1, most))


def html_text(html: Column | str) -> Column:
    """The visible text of a page: no scripts, styles, comments and tags, common entities resolved, white space joined."""
    out = F.regexp_replace(_text(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def clamp(x: Column) -> Column:
    """A score cut to [0, 1]; what is no finite number counts as 0."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two vectors in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def round_half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)

"""Text rules: HTML to text, sentences, scores, tags and dates."""

from __future__ import annotations

from . import rules as R
from .dialect import SPACES, Dialect

_HIDDEN = ("script", "style", "noscript", "template", "svg")
_CHROME = ("header", "nav", "footer", "aside")


def _without(d: Dialect, x: str, tags: tuple[str, ...], by: str = " ") -> str:
    """Drops whole elements. Lazy dots keep Java's regex off the stack on long blocks."""
    for t in tags:
        x = d.replace_all(x, rf"(?is)<{t}\b.*?</{t}>", by)
    return x


def unescape(d: Dialect, x: str) -> str:
    """The common entities; ``helpers.unescaped`` resolves all."""
    for name, value in R.ENTITIES:
        x = f"replace({x}, {d.text(name)}, {d.text(value)})"
    return x


def _trimmed_lines(d: Dialect, x: str, collapse: bool = False) -> str:
    """Trims lines (whole, at any length), keeps one empty line at most, and with ``collapse`` one space of a run."""
    x = d.join(d.each(d.split(x, "\n"), "ln", d.strip("ln")), "\n")
    if collapse:
        x = d.replace_all(x, r"[ \t]{2,}", " ")
    return d.strip(d.replace_all(x, r"\n{3,}", "\n\n"))


# Cleaning has a part before and a part after entities are resolved: jobs resolve all of them in between, expressions the common ones.

_RUNS = r"[ \t\f\x0B]+"


def _with_newlines(d: Dialect, x: str) -> str:
    return d.replace_all(x, r"\r\n?", "\n")


def before_aggressive(d: Dialect, common: str) -> str:
    """C1; all three of a text from ``clean_common``."""
    return _with_newlines(d, _without(d, common, _CHROME))


def before_lenient(d: Dialect, common: str) -> str:
    return _with_newlines(d, common)


def before_fallback(d: Dialect, common: str) -> str:
    x = d.replace_all(_with_newlines(d, common), r"(?i)<br\s*/?>", "\n")
    return d.replace_all(x, r"(?s)<[^>]+>", " ")


def after_markup(d: Dialect, x: str) -> str:
    """Runs of spaces collapse before tags go, so those that tags leave behind stay."""
    x = d.replace_all(d.replace_all(d.replace_all(x, _RUNS, " "), r"(?i)<br\s*/?>", "\n"), R.BLOCK_TAGS, "\n")
    return _trimmed_lines(d, d.replace_all(x, r"(?s)<[^>]+>", " "))


def after_fallback(d: Dialect, x: str) -> str:
    return _trimmed_lines(d, d.replace_all(x, _RUNS, " "))


def clean_common(d: Dialect, html: str) -> str:
    return d.replace_all(_without(d, html, _HIDDEN), r"(?s)<!--.*?-->", " ")


def clean_aggressive(d: Dialect, common: str) -> str:
    return after_markup(d, unescape(d, before_aggressive(d, common)))


def clean_lenient(d: Dialect, common: str) -> str:
    return after_markup(d, unescape(d, before_lenient(d, common)))


def clean_fallback(d: Dialect, common: str) -> str:
    return after_fallback(d, unescape(d, before_fallback(d, common)))


def before_strip(d: Dialect, html: str) -> str:
    x = _without(d, f"coalesce({html}, '')", ("script", "style", "noscript", "template"))
    return d.replace_all(d.replace_all(x, r"\{[^{}]{200,}\}", " "), r"<[^>]+>", " ")


def after_strip(d: Dialect, x: str) -> str:
    return d.strip(d.replace_all(x, f"[{SPACES}]+", " "))


def strip_html_keep_text(d: Dialect, html: str) -> str:
    """C2."""
    return after_strip(d, unescape(d, before_strip(d, html)))


def before_text(d: Dialect, html: str) -> str:
    x = _without(d, f"coalesce({html}, '')", ("script", "style", "noscript", "template", "svg", "canvas", "iframe"), "")
    x = d.replace_all(d.replace_all(x, r"(?i)<br\s*/?>", "\n"), r"(?i)</?(p|div|section|article|li|ul|ol|h1|h2|h3|h4|h5|h6|header|footer|nav|tr|table)\b[^>]*>", "\n")
    return d.replace_all(x, r"<[^>]+>", "")


def after_text(d: Dialect, x: str) -> str:
    x = d.replace_all(x, "[​-‍⁠﻿]", "")
    return _trimmed_lines(d, d.replace_all(x, "\r\n?|[\x0b\f\x1c-\x1e\x85\u2028\u2029]", "\n"), collapse=True)


def html_to_text(d: Dialect, html: str) -> str:
    """C3."""
    return after_text(d, unescape(d, before_text(d, html)))


def quick_text(d: Dialect, html: str) -> str:
    """C4."""
    x = d.replace_all(f"coalesce({html}, '')", r"<[^>]+>", " ")
    x = d.replace_all(f"replace({x}, '&nbsp;', ' ')", r"[ \t]+", " ")
    return d.replace_all(d.replace_all(x, r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


_SPLIT = "␞"


def sentence_parts(d: Dialect, text: str) -> str:
    """C11: an array of all parts between sentence ends, trimmed."""
    marked = d.replace_all(f"coalesce({text}, '')", r"([.?!])\s+([A-Z0-9\"'“])", f"$1{_SPLIT}$2")
    return d.each(d.split(marked, _SPLIT), "s", d.replace_all("s", r"^\s+|\s+$", ""))


def sentences(d: Dialect, text: str, answers: bool = False) -> str:
    """C11: an array of sentences; menu-like ones dropped, or for answers those outside 30 to 600 characters."""
    return d.keep(sentence_parts(d, text), "s", "length(s) BETWEEN 30 AND 600" if answers else f"s <> '' AND NOT {is_menuish(d, 's')}")


def is_menuish(d: Dialect, s: str) -> str:
    """F11."""
    letters = f"length({d.replace_all(s, r'[^\p{L}]', '')})"
    return f"(length({s}) < 30 OR {d.matches(s, R.MENU_HINTS)} OR 10 * {letters} < 4 * (length({s}) - {letters}))"


def signal_score(d: Dialect, s: str) -> str:
    """C12."""
    count = lambda kept: f"length({d.replace_all(s, kept, '')})"
    alnum, punct, bad = count(r"[^\p{L}\p{N}]"), count(r"[^.,;:?!’'“”\"()]"), count(r"[^{}\[\]<>=+/*$#_|\\`~]")
    return f"CAST({alnum} + 0.5 * {punct} AS DOUBLE) / CAST(1 + {bad} + abs(length({s}) - 180) * 0.005 AS DOUBLE)"


def tag_topics(d: Dialect, text: str) -> str:
    """A sorted array."""
    return d.sorted_set(d.array([f"CASE WHEN {d.matches(text, p)} THEN '{t}' END" for t, p in R.TOPICS.items()]))


def classify(d: Dialect, title: str, text: str) -> tuple[str, str]:
    """(label or null, confidence): hits by length, at most 1; the first of equals."""
    hay = f"lower(concat(coalesce({title}, ''), '\n', coalesce({text}, '')))"
    shares = {k: f"least(1.0, CAST(({' + '.join(d.hits(hay, p) for p in ps)}) * 200 AS DOUBLE) / greatest(500, length({hay})))" for k, ps in R.KEYWORDS.items()}
    best = f"greatest({', '.join(shares.values())})"
    return f"CASE WHEN {best} = 0 THEN NULL " + " ".join(f"WHEN {v} = {best} THEN '{k}'" for k, v in shares.items()) + " END", f"CAST({best} AS DOUBLE)"


def token_estimate(d: Dialect, x: str, how: str = "ceil") -> str:
    """U15."""
    n = f"length({x})"
    whole = {"ceil": f"({n} + 3)", "floor": n}
    if how == "round":  # half to even
        quarter = f"({n} % 4)"
        base = f"CAST(floor({n} / 4.0) AS BIGINT)"
        return f"greatest(CAST(1 AS BIGINT), {base} + CASE WHEN {quarter} > 2 OR ({quarter} = 2 AND {base} % 2 = 1) THEN 1 ELSE 0 END)"
    return f"greatest(CAST(1 AS BIGINT), CAST(floor({whole[how]} / 4.0) AS BIGINT))"


_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def _beginning_of(text: str, most: int) -> str:
    """Its first ``most`` characters (0: all)."""
    return f"substr(coalesce({text}, ''), 1, {most})" if most else f"coalesce({text}, '')"


def policy_dates(d: Dialect, text: str, most: int = 0) -> str:
    """U18: 'effective:' or 'updated:' and the ISO date of the first phrase of each of three forms (March 5, 2024; 5 March 2024; 2024-03-05): a sorted
    array. Months are full names or their first three letters; dates that the calendar does not have give nothing. ``most`` characters are read (0: all)."""
    head = _beginning_of(text, most)
    named = d.exists(d.array([f"lower({head})"]), "l_", "contains(l_, 'effective') OR contains(l_, 'updated') OR contains(l_, 'modified')")
    gap = r"\s*+(?:[:-]\s*+)?" if type(d) is Dialect else r"\s*[:-]?\s*"  # the same; Java would try every cut of a long run of spaces in two
    word = r"(?i)(effective|last\s+updated|updated|last\s+modified)" + gap
    month = lambda m: f"CASE lower({m}) " + " ".join(f"WHEN '{w}' THEN '{i + 1:02d}'" for i, k in enumerate(_MONTHS) for w in sorted({k.lower(), k[:3].lower()})) + " END"
    forms = (
        (word + r"([A-Za-z]{3,9})\s+(\d{1,2}),\s+(\d{4})", 4, 2, 3),
        (word + r"(\d{1,2})\s+([A-Za-z]{3,9})\s+(\d{4})", 4, 3, 2),
        (word + r"(\d{4})-(\d{2})-(\d{2})", 2, 3, 4),
    )
    tags = []
    for pattern, y, m, day in forms:
        got = lambda k, pattern=pattern: d.extract("m_", pattern, k)
        number = got(m) if y == 2 else month(got(m))
        iso = f"concat({got(y)}, '-', {number}, '-', lpad({got(day)}, 2, '0'))"
        key = f"CASE WHEN lower({got(1)}) = 'effective' THEN 'effective:' ELSE 'updated:' END"
        tag = f"CASE WHEN m_ <> '' AND {number} IS NOT NULL AND try_cast({iso} AS DATE) IS NOT NULL THEN concat({key}, {iso}) END"
        tags.append(d.item(d.each(d.array([d.extract("x_", pattern, 0)]), "m_", tag), "1"))  # the long text is searched once for each form
    once = d.item(d.each(d.array([f"CASE WHEN {named} THEN {head} ELSE '' END"]), "x_", d.array(tags)), "1")  # and only if it has one of the words
    return d.sorted_set(once)


def content_hash(d: Dialect, x: str) -> str:
    """SHA-256 in hex."""
    return f"sha2({x}, 256)" if type(d) is Dialect else f"sha256({x})"


def render_flags(d: Dialect, status: str, body: str, clean: str) -> dict[str, str]:
    """U16: a page that needs rendering, one of thin text, and its share of script tags."""
    tags, scripts = d.hits(body, "<"), d.hits(f"lower({body})", "<script")
    return {"needs_render": f"coalesce({status} IN (401, 403, 406, 429), false) OR length({body}) < 1800", "thin": f"length({clean}) < 600", "script_ratio": f"CASE WHEN {tags} = 0 THEN 0.0 ELSE round(CAST({scripts} AS DOUBLE) / {tags}, 6) END"}


def word_and_page_estimate(d: Dialect, x: str) -> dict[str, str]:
    """Words between spaces, and pages of 500 of them."""
    words = d.size(d.keep(d.split(x, " "), "w", "w <> ''"))
    return {"words": words, "pages": f"CAST(ceil({words} / 500.0) AS BIGINT)"}


def parse_ts(d: Dialect, raw: str) -> str:
    """Seconds since 1970 of an ISO time with or without an offset (without: UTC), or of digits; 0 for anything else."""
    iso = d.matches(raw, r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$")
    zoned = d.matches(raw, r"(Z|[+-]\d{2}:?\d{2})$")
    dated = d.matches(raw, r"^\d{4}-\d{2}-\d{2}$")
    utc = f"CASE WHEN {dated} THEN concat({raw}, 'T00:00:00+00:00') WHEN {zoned} THEN {raw} ELSE concat({raw}, '+00:00') END"
    seconds = f"unix_timestamp(try_cast({utc} AS TIMESTAMP))" if type(d) is Dialect else f"CAST(floor(epoch(try_cast({utc} AS TIMESTAMPTZ))) AS BIGINT)"
    return f"coalesce(CASE WHEN {iso} THEN {seconds} END, CASE WHEN {d.matches(raw, '^[0-9]+$')} THEN try_cast({raw} AS BIGINT) END, 0)"


def words_of(d: Dialect, x: str) -> str:
    """An array of lower-case words of letters, digits and underscores."""
    return d.extract_all(f"lower(coalesce({x}, ''))", r"[\p{L}\p{N}_]+")


def plain_words_of(d: Dialect, x: str) -> str:
    """An array of lower-case words of ASCII letters, digits and apostrophes."""
    return d.extract_all(f"lower(coalesce({x}, ''))", "[A-Za-z0-9']+")


def human_size(d: Dialect, chars: str) -> str:
    """Characters as ``1,234 KB``, or ``1.5 MB`` from one megabyte on."""
    mb, kb = f"(coalesce({chars}, 0) / 1048576.0D)", f"(coalesce({chars}, 0) / 1024.0D)"
    if type(d) is Dialect:
        return f"CASE WHEN {mb} >= 1 THEN concat(format_number({mb}, 1), ' MB') ELSE concat(format_number({kb}, 0), ' KB') END"
    mb, kb = (f"(coalesce({chars}, 0) / CAST({n} AS DOUBLE))" for n in (1048576, 1024))
    return f"CASE WHEN {mb} >= 1 THEN format('{{:,.1f}} MB', {mb}) ELSE format('{{:,.0f}} KB', {kb}) END"


def within_window(d: Dialect, tokens: str, a: str, b: str, w: int) -> str:
    """Q5: some places of a and b at most w apart. The tokens are computed once, and each place of a looks at its neighbourhood only."""
    last = f"CAST({d.size('t_')} AS INT)"
    if type(d) is Dialect:
        hit = f"get(t_, i - 1) = '{a}' AND array_contains(slice(t_, greatest(i - {w}, 1), i + {w} + 1 - greatest(i - {w}, 1)), '{b}')"
    else:
        hit = f"t_[i] = '{a}' AND list_contains(t_[greatest(i - {w}, 1):i + {w}], '{b}')"
    return f"coalesce({d.item(d.each(d.array([tokens]), 't_', d.exists(d.sequence('1', last), 'i', hit)), '1')}, false)"


def document_tags(d: Dialect, url: str, text: str, whole: bool = True) -> str:
    """G1: the sorted array of a document's tags (host, platform, type, surfaces, audiences, locale, region, frameworks, date, wall).

    Without ``whole`` only the first 4,000 characters (of frameworks 8,000, of dates 12,000) are read, as some queries' SQL does."""
    from . import urls as U

    most = (0, 0, 0) if whole else (4000, 8000, 12000)
    hay, head, low = "h_[0]", "h_[1]", "h_[2]"
    if type(d) is not Dialect:
        hay, head, low = "h_[1]", "h_[2]", "h_[3]"
    tags = [f"concat('host:', {U.host_of(d, url, with_port=False)})", f"concat('platform:', {U.platform_tag(d, url)})", f"CASE WHEN {d.ends(f'lower({url})', chr(39) + '.pdf' + chr(39))} THEN 'doc:pdf' ELSE 'doc:html' END"]
    tags += [f"CASE WHEN {d.matches_any_case(hay, 'h_[3]', p)} THEN 'surface:{t}' END" for t, p in R.SURFACES.items()]
    tags += [f"CASE WHEN {d.matches_any_case(hay, 'h_[3]', p)} THEN 'audience:{t}' END" for t, p in R.AUDIENCES.items()]
    tags += [f"CASE WHEN {d.matches_any_case(head, 'h_[4]', r'(?i)\b' + t + r'\b')} THEN 'framework:{t.lower()}' END" for t in R.FRAMEWORKS]
    tags.append("CASE WHEN " + " OR ".join(f"contains({low}, '{w}')" for w in R.AUTH_WALLS) + " THEN 'auth-wall:true' END")
    both = d.concat_lists(d.concat_lists(d.array(tags), policy_dates(d, text, most[2])), U.locale_region_tags(d, url))
    # what the patterns search is made once a row
    start = _beginning_of(text, most[0])
    parts = [f"concat(lower({url}), ' ', {start})", _beginning_of(text, most[1]), f"lower({start})"]
    if type(d) is Dialect:  # lower-case copies, in which words are looked for before patterns are
        parts += [f"lower({p})" for p in parts[:2]]
    searched = d.array(parts)
    return d.sorted_set(d.each(d.item(d.each(d.array([searched]), "h_", both), "1"), "t", "lower(trim(t))"))


def chunk_tags(d: Dialect, text: str) -> list[tuple[str, str]]:
    """(tag, hits) of every tag."""
    return [(t, " + ".join(d.hits(text, p) for p in ps)) for t, ps in R.CHUNK_TAGS.items()]

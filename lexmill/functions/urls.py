"""URL rules: parts, normal forms, inference and sieves. Each is a rule for ``dialect.column``.

The inputs are SQL texts (a column's name, for instance). A URL without ``scheme://`` has empty parts.
"""

from __future__ import annotations

from . import rules as R
from .dialect import Dialect

_HEAD = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def scheme(d: Dialect, u: str) -> str:
    return f"lower({d.extract(u, r'^([A-Za-z][A-Za-z0-9+.-]*)://', 1)})"


def netloc(d: Dialect, u: str) -> str:
    return f"lower({d.extract(u, _HEAD + r'([^/?#]*)', 1)})"


def path(d: Dialect, u: str) -> str:
    return d.extract(u, _HEAD + r"[^/?#]*([^?#]*)", 1)


def query(d: Dialect, u: str) -> str:
    return d.extract(u, r"^[^?#]*[?]([^#]*)", 1)


def fragment(d: Dialect, u: str) -> str:
    return d.extract(u, r"^[^#]*#(.*)$", 1)


def host_of(d: Dialect, u: str, strip_www: bool = False, with_port: bool = True) -> str:
    """The lower-case host, with or without port and ``www.``."""
    host = netloc(d, u) if with_port else d.extract(netloc(d, u), r"^([^:]*)", 1)
    return d.replace_all(host, r"^www\.", "") if strip_www else host


def _port(d: Dialect, u: str) -> str:
    return d.extract(netloc(d, u), r":([0-9]+)$", 1)


def normalize_url(d: Dialect, u: str) -> str:
    """Lower-case scheme and host, no default port, ``www.``, fragment, tracking parameters or trailing slash; unchanged without a scheme."""
    drop_port = f"(({scheme(d, u)} = 'http' AND {_port(d, u)} = '80') OR ({scheme(d, u)} = 'https' AND {_port(d, u)} = '443'))"
    host = f"CASE WHEN {drop_port} THEN {host_of(d, u, strip_www=True, with_port=False)} ELSE {host_of(d, u, strip_www=True)} END"
    short = d.replace_all(path(d, u), r"/+$", "")
    clean = f"CASE WHEN {path(d, u)} IN ('', '/') THEN '/' ELSE {short} END"
    pattern = r"^(" + "|".join(R.TRACKING_PREFIXES) + ")"
    kept = d.keep(d.split(query(d, u), "&"), "p", f"p <> '' AND NOT {d.matches('lower(p)', pattern)}")
    params = f"CASE WHEN {d.size(kept)} = 0 THEN '' ELSE concat('?', {d.join(kept, '&')}) END"
    return f"CASE WHEN {scheme(d, u)} = '' THEN {u} ELSE concat({scheme(d, u)}, '://', {host}, {clean}, {params}) END"


def policy_url(d: Dialect, u: str, collapse_www: str, strip_ports: str, drop_fragment: str, strip_params: str) -> str:
    """The same by a policy row's columns; strip_params is an array of wildcards, each matching a whole parameter name."""
    plain = host_of(d, u, with_port=False)
    host = f"CASE WHEN {collapse_www} THEN {d.replace_all(plain, '^www[.]', '')} ELSE {plain} END"
    port = f"CASE WHEN {_port(d, u)} = '' OR ({strip_ports} AND {_port(d, u)} IN ('80', '443')) THEN '' ELSE concat(':', {_port(d, u)}) END"
    name = d.extract("p", "^([^=]*)", 1)
    wild = f"concat('^', replace(w, '*', '.*'), '$')"  # noqa: F541
    dropped = d.exists(strip_params, "w", f"{name} RLIKE {wild}" if type(d) is Dialect else f"regexp_matches({name}, {wild})")
    kept = d.keep(d.split(query(d, u), "&"), "p", f"p <> '' AND NOT {dropped}")
    params = f"CASE WHEN {d.size(kept)} = 0 THEN '' ELSE concat('?', {d.join(kept, '&')}) END"
    hash_ = f"CASE WHEN {drop_fragment} OR {fragment(d, u)} = '' THEN '' ELSE concat('#', {fragment(d, u)}) END"
    return f"CASE WHEN {scheme(d, u)} = '' THEN {u} ELSE concat({scheme(d, u)}, '://', {host}, {port}, {path(d, u)}, {params}, {hash_}) END"


def canonical_page_url(d: Dialect, u: str) -> str:
    """Https, lower host without ``www.``, no query or fragment, no trailing slashes."""
    whole = f"concat('https://', {host_of(d, u, strip_www=True)}, CASE WHEN {path(d, u)} = '' THEN '/' ELSE {path(d, u)} END)"
    return d.replace_all(whole, r"/+$", "")


def search_canon(d: Dialect, u: str) -> str:
    """U4."""
    return f"lower(replace(replace(replace(coalesce({u}, ''), 'http://www.', 'https://'), 'http://', 'https://'), 'https://www.', 'https://'))"


def sanitize_url(d: Dialect, u: str) -> str:
    """Common entities resolved (``joins.sanitized_urls``: all), then ``after_entities``."""
    x = f"coalesce({u}, '')"
    for name, value in R.ENTITIES:
        x = f"replace({x}, {d.text(name)}, {d.text(value)})"
    return after_entities(d, x)


def after_entities(d: Dialect, x: str) -> str:
    """Cut at ``<``, trailing quotes, brackets, backslashes and punctuation gone."""
    x = d.extract(d.strip(x), r"^[^<]*", 0)
    for tail in (r"[\s'\")\]]+$", r"[\\]+$", r"[;,]+$"):
        x = d.replace_all(x, tail, "")
    return x


def resolve_link(d: Dialect, base: str, href: str) -> str:
    """Absolute form of a link without fragment; null for script, mail and same-page links. ``..`` and ``.`` segments are left to ``helpers.joined_url``."""
    cut = d.replace_all(f"trim({href})", r"#.*$", "")
    site = f"concat({scheme(d, base)}, '://', {netloc(d, base)})"
    folder = d.replace_all(path(d, base), r"[^/]*$", "")
    relative = f"concat({site}, CASE WHEN {folder} = '' THEN '/' ELSE {folder} END, {cut})"
    skip = d.matches(f"trim({href})", r"(?i)^(javascript:|mailto:|#)")
    return f"CASE WHEN {href} IS NULL OR trim({href}) = '' OR {skip} THEN NULL WHEN {d.matches(cut, '(?i)^https?://')} THEN {cut} WHEN {d.starts(cut, chr(39) + '//' + chr(39))} THEN concat({scheme(d, base)}, ':', {cut}) WHEN {d.starts(cut, chr(39) + '/' + chr(39))} THEN concat({site}, {cut}) ELSE {relative} END"


def infer_platform(d: Dialect, u: str) -> str:
    """U8: the label before the last of the host, capitalised."""
    host = host_of(d, u, strip_www=True, with_port=False)
    base = f"CASE WHEN contains({host}, '.') THEN {d.extract(host, r'([^.]*)[.][^.]*$', 1)} ELSE {host} END"
    return f"CASE WHEN ({base}) = '' THEN 'Unknown' ELSE concat(upper(substr(({base}), 1, 1)), lower(substr(({base}), 2))) END"


def platform_tag(d: Dialect, u: str) -> str:
    """U8: the platform of known hosts, else the label before the last."""
    host = host_of(d, u, with_port=False)
    known = " ".join(f"WHEN '{h}' THEN '{p}'" for h, p in R.PLATFORMS.items())
    return f"CASE {host} {known} ELSE CASE WHEN contains({host}, '.') THEN {d.extract(host, r'([^.]*)[.][^.]*$', 1)} ELSE {host} END END"


def infer_jurisdiction(d: Dialect, u: str) -> str:
    """U9."""
    p = f"lower({path(d, u)})"
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({p}, {chr(39)}{x}{chr(39)})' for x in parts)} THEN '{label}'" for label, parts in R.JURISDICTIONS) + " ELSE 'global' END"


def infer_doc_type(d: Dialect, u: str, title: str = "''", rules: str = "tagging") -> str:
    """The first matching pattern's label."""
    x = f"lower(concat({u}, ' ', coalesce({title}, '')))" if rules == "tagging" else f"lower({u})"
    return "CASE " + " ".join(f"WHEN {d.matches(x, pattern)} THEN '{label}'" for label, pattern in R.DOC_TYPES[rules]) + " ELSE 'other' END"


def domain_and_slug(d: Dialect, u: str) -> tuple[str, str]:
    """U14."""
    p = f"CASE WHEN {path(d, u)} = '' THEN '/' ELSE {path(d, u)} END"
    p = f"CASE WHEN {d.ends(p, chr(39) + '/' + chr(39))} THEN concat({p}, 'index') ELSE {p} END"
    slug = d.replace_all(d.replace_all(p, r"^/+", ""), r"[^A-Za-z0-9_.-]+", "-")
    slug = d.replace_all(d.replace_all(slug, r"-{2,}", "-"), r"^-+|-+$", "")
    return netloc(d, u), f"CASE WHEN {slug} = '' THEN 'index' ELSE {slug} END"


def locale_region_tags(d: Dialect, u: str) -> str:
    """A sorted array of locale and region tags."""
    tags = []
    for key in R.LOCALE_PARAMS:
        value = d.extract(query(d, u), rf"(?:^|&){key}=([^&]+)", 1)
        tags.append(f"CASE WHEN {value} <> '' THEN concat('locale:', {value}) END")
    for part, region in R.REGIONS:
        tags.append(f"CASE WHEN contains(lower({u}), '{part}') THEN 'region:{region}' END")
    segments = d.keep(d.split(path(d, u), "/"), "s", d.matches("s", r"^[A-Za-z]{2}(-[A-Za-z0-9]{2,5})?$"))
    return d.sorted_set(d.concat_lists(d.array(tags), d.each(segments, "s", "concat('locale:', s)")))


# --- sieves


def looks_like_legal(d: Dialect, u: str) -> str:
    """F1."""
    ends = " OR ".join(d.ends(f"lower({u})", f"'{e}'") for e in R.LEGAL_ENDS)
    return f"({d.matches(u, '(?i)(' + '|'.join(R.LEGAL_HINTS) + ')')} OR {ends})"


def is_legal_url(d: Dialect, u: str) -> str:
    """F2."""
    return f"({scheme(d, u)} IN ('http', 'https') AND {d.matches(path(d, u), '(?i)(' + '|'.join(R.LEGAL_PATHS) + ')')})"


def under(d: Dialect, host: str, root: str) -> str:
    return f"({host} = {root} OR {d.ends(host, f'concat({chr(39)}.{chr(39)}, {root})')})"


def keep_url(d: Dialect, u: str, root: str) -> str:
    """the whole sieve for a URL found from a root host."""
    host, p = netloc(d, u), path(d, u)
    clean = d.replace_all(u, "#.*$", "")
    cross = " OR ".join(f"({root} = '{r}' AND ({' OR '.join(under(d, host, chr(39) + a + chr(39)) for a in hosts)}))" for r, hosts in R.CROSS_ALLOW.items())
    denied = " OR ".join(f"contains({clean}, '{x}')" for x in R.DENIED_ANYWHERE)
    denied += "".join(f" OR ({under(d, host, chr(39) + h + chr(39))} AND ({' OR '.join(f'contains({clean}, {chr(39)}{x}{chr(39)})' for x in items)}))" for h, items in R.HOST_DENY.items())
    allowed = "CASE " + " ".join(f"WHEN {under(d, host, chr(39) + h + chr(39))} THEN {d.matches(p, '(?i)(' + '|'.join(ps) + ')')}" for h, ps in R.HOST_ALLOW.items()) + " ELSE true END"
    return f"({scheme(d, u)} IN ('http', 'https') AND NOT {d.matches(clean, R.BLOCKED_ENDINGS)} AND NOT {d.matches(p, R.NOISE_FOLDERS)} AND ({under(d, host, root)} OR {cross}) AND NOT ({denied}) AND {allowed} AND {d.matches(clean, R.SIEVE_HINTS)})"


def is_probably_asset(d: Dialect, u: str, allow_pdf: bool = True) -> str:
    """F5."""
    p = path(d, u)
    found = f"({d.matches(u, R.TRACKERS)} OR {d.matches(p, R.ASSET_ENDINGS)} OR {d.matches(p, R.ASSET_PATHS)} OR {d.matches(query(d, u), R.ASSET_QUERIES)})"
    return f"(NOT {d.ends(f'lower({p})', chr(39) + '.pdf' + chr(39))} AND {found})" if allow_pdf else found


def is_noise(d: Dialect, u: str, extra: tuple[str, ...] = ()) -> str:
    """a noise pattern and nothing that is to be kept."""
    return f"({d.matches(u, '(?i)(' + '|'.join((*R.NOISE, *extra)) + ')')} AND NOT {d.matches(u, '(?i)(' + '|'.join(R.NOISE_KEPT) + ')')})"


def is_bad_url(d: Dialect, u: str) -> str:
    """the LIKE lists, which ignore the case of letters."""
    return "(" + " OR ".join(f"{u} ILIKE '{p}'" for p in R.BAD_LIKE) + ")"


def looks_like_policy_path(d: Dialect, u: str) -> str:
    """F8: a keyword, and shallow (not below help or news parts), or one of the exact slugs when deeper."""
    p = f"lower({path(d, u)})"
    inner = d.replace_all(p, "^/+|/+$", "")
    depth = f"(length({inner}) - length(replace({inner}, '/', '')))"
    return f"({d.matches(p, R.POLICY_PATH)} AND CASE WHEN {depth} <= 3 THEN NOT {d.matches(p, R.POLICY_DOWNRANKED)} ELSE {d.matches(p, R.POLICY_SLUGS)} END)"


def link_filter(d: Dialect, u: str, kind: str = "keywords") -> str:
    """F12."""
    return d.matches(u, R.LINK_FILTERS[kind])


def footer_hint(d: Dialect, text: str) -> str:
    return d.matches(text, R.FOOTER_HINTS)


def norm_platform(d: Dialect, x: str) -> str:
    """U19."""
    return f"trim(replace(replace(lower(coalesce({x}, '')), 'www.', ''), '.com', ''))"


def norm_jurisdiction(d: Dialect, x: str) -> str:
    return f"trim(lower(coalesce({x}, '')))"

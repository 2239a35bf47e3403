"""The patterns and lists that results depend on, in their order."""

# --- fixed values: URL normalisation
TRACKING_PREFIXES = ("utm_", "gclid", "fbclid", "mc_eid", "igshid")

# --- fixed values: document types by ordered patterns, three rule sets
DOC_TYPES = {
    "tagging": (("privacy", r"privacy"), ("terms", r"terms|tos|terms-of-service"), ("guidelines", r"guidelines|community|rules|standards|code-of-conduct"), ("ads", r"ads|advertis"), ("policy", r"policy|policies|legal"), ("children", r"children|minors|kid|youth|under\s*13"), ("ip", r"copyright|dmca|ip|intellectual[- ]property"), ("cookie", r"cookie"), ("safety", r"moderation|enforcement|safety|abuse|harassment")),
    "bot": (("privacy", r"privacy"), ("terms", r"terms|tos"), ("guidelines", r"guidelines|community|rules"), ("ads", r"ads|advertis"), ("policy", r"policy|policies|legal"), ("children", r"children|minors|youth|kid"), ("ip", r"copyright|dmca|ip")),
    "discover": (("privacy", r"privacy|cookie"), ("terms", r"terms|tos|conditions"), ("guidelines", r"guidelines|community|rules|moderation"), ("ads", r"ads|advertis(e|ing)"), ("ip", r"ip|copyright|dmca|trademark"), ("policy", r"policy|policies|legal|safety|security|trust"), ("children", r"child|children|minor|youth|coppa")),
}

# --- fixed values: jurisdictions by path parts
JURISDICTIONS = (("eu", ("/eu", "/en-eu", "/europe")), ("uk", ("/uk", "/en-gb")), ("us", ("/us", "/en-us")))

# --- fixed values: classification keywords
KEYWORDS = {
    "tos": (r"\bterms\b", r"\bterms\s+of\s+(use|service)\b", r"\buser\s+agreement\b", r"\bcommunity\s+guidelines?\b", r"\bcommunity\s+standards?\b"),
    "privacy": (r"\bprivacy\b", r"\bdata\s+protection\b", r"\bpersonal\s+data\b"),
    "ads": (r"\badvertis(ing|ement)s?\b", r"\bendorsements?\b", r"\bpaid\s+partnerships?\b"),
    "commerce": (r"\bprohibited\s+items?\b", r"\bcounterfeit\b", r"\breturns?\b", r"\brefunds?\b"),
    "regulation": (r"\bcode\b", r"\bsection\s+\d+", r"\bcfr\b", r"\bregulation(s)?\b", r"\blaw\b"),
    "developer": (r"\bapi\b", r"\bplatform\s+policy\b", r"\bdeveloper\b"),
    "appeals": (r"\bappeal(s)?\b", r"\baccount\s+status\b", r"\bviolations?\b", r"\bmoderation\b"),
}

# --- fixed values: topics
TOPICS = {
    "medical-claims": r"(?i)\b(cure|treats?|disease|FDA|clinical|symptom)\b",
    "weight-loss": r"(?i)\b(weight\s*loss|fat\s*burn|before\s*and\s*after)\b",
    "counterfeit": r"(?i)\b(counterfeit|fake|replica)\b",
    "adult-content": r"(?i)\b(explicit|porn|sexual)\b",
    "political-ads": r"(?i)\b(political\s*ad|election|campaign)\b",
    "privacy": r"(?i)\b(personal\s*data|consent|cookie|GDPR|CCPA)\b",
}

# --- fixed values: legal URL hints
LEGAL_HINTS = (r"/privacy(\b|-|/)", r"/legal(\b|-|/)", r"/terms(\b|-|/)", r"/policy(\b|-|/)", r"/policies(\b|-|/)", r"/community(\b|-|/)", r"/guidelines(\b|-|/)", r"/help(\b|-|/).*policy", r"/support(\b|-|/).*policy", r"/ads(\b|-|/)", r"/advertising(\b|-|/)", r"/safety(\b|-|/)", r"/security(\b|-|/)", r"/compliance(\b|-|/)", r"/cookie(\b|-|/)", r"/cookies(\b|-|/)", r"/data(\b|-|/).*retention", r"/children(\b|-|/)", r"/youth(\b|-|/)", r"/dmca(\b|-|/)", r"/copyright(\b|-|/)", r"/ip(\b|-|/)")
LEGAL_ENDS = ("/legal", "/policies", "/policy")
LEGAL_PATHS = (r"/privacy", r"/data[-_/]?(policy|protection|processing|usage|collection|security)", r"/terms", r"/tos\b", r"/eula\b", r"/agreement", r"/user[-_/]?agreement", r"/policy", r"/policies", r"/legal", r"/compliance", r"/cookie", r"/cookies", r"/cookie[-_/]?policy", r"/cookie[-_/]?notice", r"/cookie[-_/]?settings", r"/children", r"/minor", r"/youth", r"/child[-_/]safety", r"/age[-_/]verification", r"/safety", r"/moderation", r"/community[-_/]?guidelines", r"/rules", r"/delet(e|ion)[-_/]?(account|profile)", r"/account[-_/]?delet", r"/retention", r"/data[-_/]?retention", r"/gdpr", r"/ccpa", r"/cpra", r"/lgpd", r"/pipa", r"/sccs?", r"/standard[-_/ ]contractual[-_/ ]clauses")
SIEVE_HINTS = r"(?i)(privacy|cookie(?:s|-policy)?|polic(?:y|ies)|legal|terms(?:-of-service)?|conditions|community[- ]?guidelines?|safety|moderation|consent|retention|deletion|erasure|account|gdpr|ccpa|ad[- ]?polic(?:y|ies))"
BLOCKED_ENDINGS = r"(?i)\.(?:png|jpe?g|gif|webp|svg|ico|css|js|mjs|map|woff2?|ttf|otf|eot|mp4|mov|avi|mkv|mp3|wav|flac)$"
NOISE_FOLDERS = r"(?i)/(_next/|static/|assets?/|images?/|fonts?/|~gitbook/)"

# --- fixed values: hosts that a root allows besides its own
CROSS_ALLOW = {
    "youtube.com": ("policies.google.com",),
    "www.youtube.com": ("policies.google.com",),
    "www.snapchat.com": ("snap.com", "www.snap.com", "values.snap.com"),
    "snapchat.com": ("snap.com", "www.snap.com", "values.snap.com"),
    "www.reddit.com": ("www.redditinc.com", "redditinc.com"),
    "reddit.com": ("www.redditinc.com", "redditinc.com"),
    "x.com": ("help.twitter.com", "legal.twitter.com", "privacy.x.com", "business.x.com", "developer.x.com", "twitter.com", "www.twitter.com"),
    "www.x.com": ("help.twitter.com", "legal.twitter.com", "privacy.x.com", "business.x.com", "developer.x.com", "twitter.com", "www.twitter.com"),
}

# --- fixed values: path prefixes that listed hosts allow, in order (the first matching host decides)
HOST_ALLOW = {
    "instagram.com": ("^/legal", "^/privacy", "^/terms"),
    "facebook.com": ("^/privacy", "^/polic", "^/policy", "^/legal", "^/terms"),
    "youtube.com": ("^/t/terms", "^/about/policies", "^/howyoutubeworks", "^/safety"),
    "vimeo.com": ("^/terms", "^/privacy", "^/cookie", "^/legal", "^/policy"),
    "pinterest.com": ("^/policy", "^/policies", "^/terms", "^/privacy"),
    "linkedin.com": ("^/legal",),
    "discord.com": ("^/terms", "^/privacy", "^/guidelines"),
    "twitch.tv": ("^/p/en/legal", "^/terms", "^/privacy", "^/cookie"),
    "www.snapchat.com": ("^/terms", "^/cookie", "^/privacy", "^/polic", "^/policy"),
    "snap.com": ("^/terms", "^/polic", "^/policy", "^/cookie"),
    "www.whatsapp.com": ("^/legal", "^/terms", "^/privacy", "^/policy", "^/cookies"),
    "www.messenger.com": ("^/privacy", "^/legal", "^/terms", "^/policy"),
    "telegram.org": ("^/privacy", "^/terms", "^/policy", "^/legal"),
    "www.reddit.com": ("^/polic", "^/policy", "^/help", "^/community"),
    "x.com": ("^/tos", "^/privacy", "^/rules", "^/en/tos"),
    "medium.com": ("^/legal", "^/privacy", "^/terms", "^/cookie"),
    "substack.com": ("^/privacy", "^/terms", "^/cookie", "^/ccpa"),
    "quora.com": ("^/polic", "^/policy", "^/legal", "^/terms", "^/cookie"),
    "tiktok.com": ("^/legal", "^/privacy", "^/policy", "^/safety", "^/community-guidelines"),
    "www.threads.net": ("^/legal", "^/privacy", "^/terms"),
}
DENIED_ANYWHERE = ("?next=", "/accounts/login", "/login.php?next=", "/recover/initiate", "/signin", "/sign-in", "/m/signin")
HOST_DENY = {"pinterest.com": ("/pin/", "/ideas/", "/search/"), "youtube.com": ("/ads",), "vimeo.com": ("/blog/",), "quora.com": ("/q/", "/profile/"), "medium.com": ("/feed/", "/m/signin", "/signin"), "www.instagram.com": ("/explore/", "/shop/"), "www.reddit.com": ("/r/",), "substack.com": ("/topics/", "/p/")}

# --- fixed values: strict pruning
PRUNE_ALLOW = r"(?i)(privacy|data[-_/ ]?(policy|protection|processing|control|rights|transfer|retention)|terms|tos|conditions|legal|policy|policies|cookie(s|[-_/ ]?policy|[-_/ ]?notice)|safety|security|guardian|parent|children|minors?|account[-_/ ]?(delet|remov|eras|closure|terminate)|moderation|community[-_/ ]?guidelines|rules|advertis|ads?|target|profil(ing|e)|gdpr|ccpa|cpra|dsa|dma|eprivacy|transparency|consent|rights|reporting|appeals?)"
PRUNE_DENY = r"(?i)(/sitemap|sitemaps?/|\.xml(\.gz)?$|/tag/|/category/|/feed/|/news/|/press/|/blog/|/investor)"
ALLOWED_LABELS = ("www", "help", "support", "about", "legal", "policy", "policies", "privacy", "business", "company", "docs", "safety", "security")

# --- fixed values: assets, noise and sanity patterns
ASSET_ENDINGS = r"(?i)\.(?:png|jpe?g|gif|webp|avif|svg|ico|css|js|mjs|woff2?|ttf|otf|mp4|webm|mov|m4v|mp3|wav|ogg|zip|7z|rar|tar|gz)$"
ASSET_PATHS = r"(?i)(/~gitbook/image|/(?:static|assets|img|images|media|embed)/)"
ASSET_QUERIES = r"(?i)(?:\bwidth=|\bdpr=|\bquality=|\bformat=)"
TRACKERS = r"(?i)(/l/\?logging_data|[?&](?:utm_[a-z]+|fbclid|gclid)=)"
NOISE = (r"\.xml(\.gz)?$", r"/sitemap", r"/login", r"/recover", r"[?&]next=")
NOISE_KEPT = ("privacy", "terms", "policy", "policies", "legal", "cookie", "safety", "children", "parents", "consent", "deletion", "retention", "ads", "target")
BAD_LIKE = ("%/~gitbook/image%", "%/static/%", "%/assets/%", "%/images/%", "%/img/%", "%/fonts/%", "%/oembed/%", "%/embed/%", "%.png%", "%.jpg%", "%.jpeg%", "%.gif%", "%.webp%", "%.svg%", "%.ico%", "%.mp4%", "%.webm%", "%.mov%", "%.mp3%", "%.wav%", "%.ogg%", "%width=%", "%dpr=%", "%quality=%", "%token=%", "%sign=%", "%sv=%")
SANITY_CHECKS = {
    "hl params": "url ILIKE '%youtube.com%' AND url ILIKE '%?hl=%'",
    "override_hl params": "url ILIKE '%youtube.com%' AND url ILIKE '%override_hl=%'",
    "blog pages": "url ILIKE '%vimeo.com/blog%'",
    "help or legal": "url ILIKE '%linkedin.com%' AND url NOT ILIKE '%/legal%'",
    "tracker params": "url ILIKE '%utm_%' OR url ILIKE '%fbclid%' OR url ILIKE '%gclid%'",
}
POLICY_PATH, POLICY_DOWNRANKED = r"(privacy|terms|policy|legal|guidelines)", r"(/help|/blog|/press|/news|/about)"
POLICY_SLUGS = r"(privacy-policy|terms-of-service|terms_and_conditions|community-guidelines|legal/privacy|legal/terms)"
MENU_HINTS = r"(?i)(navigation|menu|footer|breadcrumbs|cookie\s*banner|subscribe|share)"
LINK_FILTERS = {
    "keywords": r"(?i)(privacy|terms|community|policy|policies|legal|guidelines|safety|advertising|ads|ip|copyright|dmca|children|minors|trust|moderation|transparency|gdpr)",
    "policy": r"(?i)(privacy|terms|legal|policy|policies|guidelines|community|cookie|cookies|ads|advertis(e|ing)|safety|security|children|kid|minor|youth|trust|content-policy)",
    "sitemap": r"(?i)(privacy|terms|policy|legal|guidelines)",
    "browser": r"(?i)(privacy|cookie|polic(y|ies)|legal|terms|safety|guidelines)",
}
FOOTER_HINTS = r"(?i)(terms|privacy|policy|policies|legal|guidelines|safety|trust|ads|advertising|help|support)"
LIKELY_PATHS = ("/legal/privacy", "/privacy", "/privacy-policy", "/legal/terms", "/terms", "/terms-of-service", "/tos", "/policies", "/policy", "/community-guidelines", "/rules", "/legal", "/help/center", "/safety", "/about/policies")

# --- fixed values: document tags
SURFACES = {
    "privacy": r"(?i)(privacy|privacy-policy|data[- ]?policy|data[- ]?protection)",
    "terms": r"(?i)(terms|tos|terms-of-service|conditions)",
    "cookies": r"(?i)(cookie|cookies)",
    "guidelines": r"(?i)(guidelines|community[- ]?guidelines|rules|code[- ]?of[- ]?conduct)",
    "safety": r"(?i)(safety|trust[- ]?and[- ]?safety|moderation|harm|abuse)",
    "ads": r"(?i)(ads|advertising|ad[- ]?policy|ad[- ]?policies|business[-/])",
    "ip": r"(?i)(ip|copyright|dmca|intellectual[- ]?property|trademark|brand)",
    "developer": r"(?i)(developer|api|platform[- ]?policy|dev[-/])",
    "transparency": r"(?i)(transparency|report|enforcement[- ]?report|ad[- ]?transparency)",
    "enforcement": r"(?i)(enforcement|penalties|violations|strikes|appeal)",
}
AUDIENCES = {"advertisers": r"(?i)(ads|advertiser|business|brand|campaign|iab)", "creators": r"(?i)(creator|partner|monetization|publisher)", "developers": r"(?i)(developer|api|sdk|app|apps|dev)", "publishers": r"(?i)(press|media)", "users": r"(?i)(user|consumer|member|account)"}
FRAMEWORKS = ("GDPR", "CCPA", "COPPA", "DSA", "DMA", "DMCA", "HIPAA", "PIPEDA")
REGIONS = (("eea", "eea"), ("eu", "eu"), ("/uk/", "uk"), ("-gb", "uk"), ("en-gb", "uk"), ("/us/", "us"), ("-us", "us"), ("/ca/", "ca"), ("-ca", "ca"), ("/au/", "au"), ("-au", "au"), ("/in/", "in"), ("-in", "in"), ("/jp/", "jp"), ("-jp", "jp"))
LOCALE_PARAMS = ("hl", "lang", "locale")
AUTH_WALLS = ("log in to continue", "you must log in to continue", "sign in to continue")
PLATFORMS = {
    "www.youtube.com": "youtube", "youtube.com": "youtube", "policies.google.com": "google", "google.com": "google",
    "x.com": "twitter", "twitter.com": "twitter", "help.twitter.com": "twitter", "help.x.com": "twitter",
    "www.facebook.com": "facebook", "facebook.com": "facebook", "www.instagram.com": "instagram", "instagram.com": "instagram",
    "www.linkedin.com": "linkedin", "linkedin.com": "linkedin", "legal.linkedin.com": "linkedin", "help.linkedin.com": "linkedin",
    "www.tiktok.com": "tiktok", "tiktok.com": "tiktok", "www.snap.com": "snap", "snap.com": "snap", "www.snapchat.com": "snapchat", "snapchat.com": "snapchat", "values.snap.com": "snap",
    "vimeo.com": "vimeo", "www.vimeo.com": "vimeo", "discord.com": "discord", "telegram.org": "telegram", "www.pinterest.com": "pinterest", "pinterest.com": "pinterest",
    "www.reddit.com": "reddit", "reddit.com": "reddit", "medium.com": "medium", "policy.medium.com": "medium", "substack.com": "substack", "www.substack.com": "substack",
    "www.twitch.tv": "twitch", "twitch.tv": "twitch", "www.quora.com": "quora", "quora.com": "quora",
}

# --- fixed values: chunk tags
CHUNK_TAGS = {
    "children_data": (r"(?i)\b(child|children|minor|teen)s?\b", r"(?i)\b(parental|guardian|age[- ]?verification|consent)\b"),
    "account_deletion": (r"(?i)\b(delete|deletion|erase|erasure|remove)\b", r"(?i)\b(account|profile)\b"),
    "advertising_targeting": (r"(?i)\b(advertis\w*|target\w*|profil\w*)\b",),
    "cookie_retention": (r"(?i)\bcookies?\b", r"(?i)\b(retention|expire|expiration|max[- ]?age|duration)\b"),
    "data_transfer": (r"(?i)\b(transfer|SCCs?|standard contractual clauses|EEA|EU|GDPR)\b",),
    "data_subject_rights": (r"(?i)\b(access|rectif\w*|correct\w*|portab\w*|erasure|object\w*)\b", r"(?i)\bright(s)?\b"),
}

# --- fixed values: coverage
COVERAGE = {
    "privacy": r"(?i)(privacy|data[- ]?protection|gdpr|ccpa)",
    "terms": r"(?i)(terms|conditions|tos|user[- ]?agreement)",
    "community_rules": r"(?i)(community|guidelines|standards|rules|content[- ]?policy)",
    "safety": r"(?i)(safety|trust|security)",
    "children_parents": r"(?i)(child|children|minor|teen|parent|guardian|youth|kids?)",
    "cookies": r"(?i)(cookie|cookies|cookie[- ]?policy|cookie[- ]?notice)",
    "deletion_retention": r"(?i)(delete|deletion|erase|erasure|retention|data[- ]?retention|account[- ]?deletion)",
    "ads_targeting": r"(?i)(ads?|advertis(e|ing)|target(ing)?|personaliz(e|ation)|profil(ing|e))",
    "appeals_moderation": r"(?i)(appeal|moderation|report|enforcement|suspend|ban)",
}
SURFACE_SEEDS = {"privacy": "/privacy", "terms": "/terms", "cookies": "/cookies", "guidelines": "/community-guidelines", "safety": "/safety", "ads": "/ads", "ip": "/copyright", "transparency": "/transparency"}

# --- fixed values: entities that the expression form resolves, and mojibake pairs
ENTITIES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&amp;", "&"))
MOJIBAKE = (("â€™", "’"), ("â€˜", "‘"), ("â€œ", "“"), ("â€“", "–"), ("â€”", "—"), ("â€", "”"), ("Â ", ""), ("Â", ""), ("ï»¿", ""), ("¦", " "))
#: Further repairs: an apostrophe, a dash, and what is left of both (patterns with Unicode classes).
GARBLED = ((r"([A-Za-z])ãs\b", "$1’s"), (r"([A-Za-z])âs\b", "$1’s"), (r"(\w)á\s", "$1 — "), (r"\sá(\w)", " — $1"), ("á", ""))
#: Object blobs with one of these names are user interface, in this order.
BLOB_KEYS = ("className", "children", "props")
#: An absolute URL anywhere in a page.
ABSOLUTE_URL = r"""https?://[^\s"'>)\\<]+"""
#: Where greedy chunks end, best kind first; lines that begin a block of structured chunks, and where their sentences end.
BREAKS = ("\n\n", "\n", ". ", "。", "! ", "? ", "; ")
HEADING = r"^\s*(?:#{1,6}\s+|[0-9]{1,2}\.|[IVX]{1,5}\.|(?:Appendix|Section|Article|Privacy Policy|Terms(?: of Service)?)\b)"
SENTENCE_END = r"(?<=[.?!])[\t ]+(?=[A-Z(])|(?<=[.?!])\n+(?=\S)"
#: Tags that end a line of text.
BLOCK_TAGS = r"(?is)</?(?:p|div|section|article|li|ul|ol|dl|dt|dd|table|thead|tbody|tfoot|tr|td|th|pre|blockquote|main|h[1-6])[^>]*>"
#: What columns of change tables are called: by role, the preferred names and the pattern of others.
COLUMN_ROLES = {
    "url": ("url", r"url|link|href"),
    "prev_hash": ("prev_hash", r"(prev|old|before).*hash|hash.*(prev|old|before)"),
    "new_hash": ("new_hash", r"(new|curr|after).*hash|hash.*(new|curr|after)|content_hash"),
    "prev_text": ("prev_text", r"(prev|old|before).*(text|body)"),
    "new_text": ("new_text", r"(new|curr|after).*(text|body)"),
    "changed_at": ("created_at", r"(changed|created|observed|fetched)_at|(^|_)(ts|time|date)$"),
    "change_kind": ("kind", r"kind|reason|type"),
}

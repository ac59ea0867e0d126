"""Patterns and word lists that results depend on."""

# --- fixed values: URL and title rules ---------------------------------------------------------
DOMAIN_BLOCK = r"(?i)(coinspeaker|cryptopolitan|benzinga\.com/pressreleases|globenewswire|prnewswire|businesswire|einpresswire|openpr|newswire\.ca|finanzen\.net|finanznachrichten|marketscreener|simplywall\.st|zacks\.com|stocktitan|accesswire|newsfilecorp|themarketsdaily|tickerreport|americanbankingnews|wkrb13|etfdailynews|theenterpriseleader|modernreaders|dispatchtribunal|thelincolnianonline|macroaxis|marketbeat|menafn|devdiscourse|latestly|webindia123|indiaeducationdiary|openpr|mexc\.com|bitget|gate\.io|binance\.com/en/news|coinmarketcap\.com/community)"
TITLE_BLOCK = r"(?i)(Trims? Stock|Stock Position|Shares Sold by|Purchases New Shares|Sells \d|Buys \d|Position (Raised|Lowered|Boosted|Trimmed|Increased|Decreased)|Acquires New (Shares|Position|Stake)|13F|Short Interest (Up|Down)|Price Target (Raised|Lowered)|Reiterates|Given a \"|Coverage Initiated|Trading (Up|Down) [\d.]+%|Sets New \d+-(Week|Month|Year))"
TIER_A = r"(?i)(reuters\.com|apnews\.com|bbc\.co|bbc\.com|nytimes\.com|washingtonpost\.com|wsj\.com|ft\.com|bloomberg\.com|economist\.com|theguardian\.com|npr\.org|cnn\.com|cnbc\.com|aljazeera\.com|dw\.com|france24\.com|politico\.|axios\.com|thehill\.com|nature\.com|science\.org|newscientist\.com|scientificamerican\.com|techcrunch\.com|theverge\.com|arstechnica\.com|wired\.com|zdnet\.com|theregister\.com|venturebeat\.com|semianalysis\.com|ieee\.org|nasdaq\.com|marketwatch\.com|barrons\.com|fortune\.com|businessinsider\.com|forbes\.com|hbr\.org|thehindu\.com|indianexpress\.com|hindustantimes\.com|economictimes\.indiatimes\.com|scmp\.com|japantimes\.co\.jp|straitstimes\.com|smh\.com\.au|abc\.net\.au|cbc\.ca|globeandmail\.com|irishtimes\.com|elpais\.com/english|spiegel\.de/international)"
SKIP_URL = r"(?i)(youtube\.com|youtu\.be|twitter\.com|x\.com/|reddit\.com|news\.ycombinator|\.pdf$|\.zip$|\.mp4$|github\.com/[^/]+/[^/]+/?$|gitlab\.com|linkedin\.com|facebook\.com|instagram\.com|tiktok\.com|docs\.google\.com|drive\.google\.com|imgur\.com)"
BLOCKED_SUBSTRINGS = ("substack.com", "medium.com", "blogspot.", "wordpress.com", "reddit.com", "quora.com", "facebook.com", "x.com", "twitter.com", "youtube.com", "tiktok.com", "pinterest.")

# --- fixed values: scaffolding that generators leave at the top of a text ----------------------
LEAD_HEADER = r"(?i)^\s*(?:#{1,6}\s*)?\**\s*(?:(?:Document|Doc)\s*\d+\s*[:.\-]?|\d{1,2}\s*[.):])\s*[^\n]{0,120}?\**\s*$"
LEAD_TITLE = r"^\s*(?:#{1,6}\s*[^\n]{3,120}|\*\*[^\n*]{3,120}\*\*)\s*$"
FORMAT_WORDS = r"(?i)wire (?:service|brief)|news report|analysis|explainer|encyclopedia|timeline|faq|question-and-answer|live ?blog|profile|newspaper|broadcast script|newsletter|fact.?check|retrospective|briefing memo|editorial|academic note|market note|transcript|letter to the editor|summary|follow-up report"

# --- fixed values: language that refers to source material or the task -------------------------
CONTAMINATION = {
    "source material": r"(?i)\bsource material\b",
    "provided/supplied material": r"(?i)\b(provided|supplied|given|attached)\s+(news\s+)?(snippet|material|excerpt|passage)s?\b",
    "the provided/supplied text": r"(?i)\bthe (provided|supplied|given|above|following)\s+(text|article|document|report|snippet)s?\b",
    "the text states/mentions": r"(?i)\bthe (text|passage|excerpt|material|source)\s+(states|mentions|says|indicates|notes|does not mention)\b",
    "research notes": r"(?i)\bresearch notes\b",
    "not mentioned in the source": r"(?i)\bnot (mentioned|stated|specified|provided) in the\s+(text|article|material|source|snippet|document)s?\b",
    "according to the provided": r"(?i)\baccording to the (provided|supplied|above|following)\b",
    "based on the provided": r"(?i)\bbased on the (provided|supplied|above|following)\s+(text|material|article|information|snippet|document|report)s?\b",
    "residual Document N": r"(?i)\bDocument\s+\d+\s*[:.]",
    "fact-check scaffolding": r"(?i)\*\*(Claim|Verdict)\s*\d*\s*[:.]",
}
META = r"(?i)the (?:provided|supplied|source) (?:material|text|context|reports?|summar\w+|snippets?)|(?:included|stated|mentioned|found) in the provided|\bthe user (?:requested|asked)|\bI will write \d+|Each document (?:stands alone|must stand alone)|uses only facts from|\bthe available facts\b|\bper the instructions\b"
HYGIENE = r"(?i)provided (context|reports?|text|material|snippets?|headlines|list|news)|the user has (provided|given|supplied)|news snippets|these headlines|the prompt (does not |doesn't )?contain"
BOILERPLATE = r"^.*(?:undefined\?location=|redirectUrl=%|\[here\.\]\(undefined).*$"

# --- fixed values: chat control strings (the bars are full-width) ------------------------------
BOS, EOS, USER, ASSISTANT, THINK_OPEN, THINK_CLOSE = "<｜begin▁of▁sentence｜>", "<｜end▁of▁sentence｜>", "<｜User｜>", "<｜Assistant｜>", "<think>", "</think>"
DOC_PROMPT = "The following is a document from {date}:\n\n"
DOC_SEP, QA_SEP = "<<<DOC>>>", "<<<QA>>>"

# --- fixed values: words that don't tell an answer apart ---------------------------------------
STOP = ("the", "a", "an", "of", "in", "on", "at", "to", "and", "or", "is", "was", "were", "for", "by", "with", "from", "as", "that", "least", "about", "approximately", "over", "than", "its", "it", "his", "her", "their", "they", "he", "she", "be", "been", "has", "have")

# --- fixed values: stream priorities -----------------------------------------------------------
STREAMS = {"deaths": 0, "wiki": 1, "hn": 2, "docs": 3}
UNKNOWN_PRIORITY = 9

# --- fixed values: what generators say before a document, whole lines -------------------------
PREAMBLE = r"(?i)^(?:\s*(?:here (?:is|'s)[^\n]*\n+|certainly[^\n]*\n+|sure[^\n]*\n+|```[a-z]*\n|\*\*?document\*\*?:?\s*\n+|document:\s*\n+))+"

# --- fixed values: what answers trained on are dropped for ------------------------------------
HYGIENE_TRAINED = r"(?i)provided (context|reports?|text|material|snippets?|headlines|list|news)|the user has (provided|given|supplied)|news snippets|these headlines|the (article|document) (says|states|mentions)"

# --- fixed values: words of an article on a death ---------------------------------------------
DEATH = r"(?i)\b(died|death|dies|passed away|obituary|dead|posthum)"

# --- fixed values: an entry of a list of deaths, and its steps from markup to prose --------------
DEATH_ENTRY = r"^\*\s*\[\[([^\]|]+)(?:\|[^\]]*)?\]\]\s*,?\s*(.*)$"
ENTRY = ((r"(?s)<ref[^>]*>.*?</ref>", ""), (r"<ref[^>]*/>", ""), (r"\[\[([^\]|]+)\|([^\]]+)\]\]", r"$2"), (r"\[\[([^\]]+)\]\]", r"$1"), (r"\{\{[^{}]*\}\}", ""), (r"'''?", ""), (r"\s+", " "))

# --- fixed values: steps from wiki markup to prose, as (pattern, replacement) --------------------
WIKI = (
    (r"^\{\{Current events[^\n]*\n", ""), (r"(?s)<!--.*?-->", ""), (r"\[https?://[^\s\]]+\s*([^\]]*)\]", r"$1"), (r"\{\{ship\|[^}]*?\|([^|}]+)\|[^}]*\}\}", r"$1"),
    (r"\{\{[^{}]*\}\}", ""), (r"\{\{[^{}]*\}\}", ""), (r"\[\[[^\]|]*\|([^\]]*)\]\]", r"$1"), (r"\[\[([^\]]*)\]\]", r"$1"), (r"'''?", ""), (r"</?[a-zA-Z][^>]*>", ""),
)

# --- fixed values: outlets that come first when a quota is filled ------------------------------
PREFERRED = (
    "apnews.com", "reuters.com", "bbc.com", "bbc.co.uk", "npr.org", "cnn.com", "nytimes.com", "washingtonpost.com", "theguardian.com", "aljazeera.com", "cbsnews.com", "nbcnews.com", "abcnews.go.com",
    "politico.com", "axios.com", "time.com", "usatoday.com", "newsweek.com", "thehill.com", "pbs.org", "japantimes.co.jp", "kyodonews.net", "nhk.or.jp", "asahi.com", "mainichi.jp", "timesofisrael.com",
    "jpost.com", "haaretz.com", "france24.com", "dw.com", "variety.com", "deadline.com", "hollywoodreporter.com", "billboard.com", "en.wikipedia.org", "sky.com", "news.sky.com", "independent.co.uk", "ft.com",
)

# --- fixed values: the least lengths of texts, and whether a text of that very length stays ------
LEAST = {
    "news": (400, True), "stories": (500, True), "articles": (600, True), "training": (350, True), "cleaned": (300, True), "short": (200, True),
    "source": (400, False), "formats": (300, False), "generated": (250, False), "summary": (800, False),
}

# --- fixed values: frequent words that vote for a text's language -------------------------------
FREQUENT = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "was", "on", "are", "by", "this", "from"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "ein", "eine", "mit", "von", "zu", "den", "auf", "im", "für"),
    "fr": ("le", "la", "les", "des", "et", "est", "une", "dans", "pour", "que", "qui", "sur", "pas", "au", "du"),
    "es": ("el", "la", "los", "las", "que", "en", "y", "una", "por", "con", "para", "del", "se", "es", "un"),
}

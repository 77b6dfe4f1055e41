"""Rules, registries and parameters, as data."""

from __future__ import annotations

# --- Fixed values: punctuation folding -------------------------------------------------------------------
QUOTES = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "“": '"', "”": '"', "„": '"', "″": '"'}
DASHES = {c: "-" for c in "‐‑‒–—―−"}
SPACES = {c: " " for c in "       "}
ELLIPSIS = "…"
POINT_NAMESPACE = "6f1c3a52-9d0e-4f5b-8a7e-2c4b1d9e0a31"

# --- Fixed values: cleaning ------------------------------------------------------------------------------
SYMBOL_PATTERNS = ["[★☆]+", "[\U0001f300-\U0001faff]", "[✀-➿]", "[®™]", "»", "[•·]"]
URL_PATTERNS = [r"""https?://[^\s<>"]*[^\s<>".,;:!?)\]]""", r"""www\.[^\s<>"]*[^\s<>".,;:!?)\]]"""]
MIN_WORDS = 80
TITLE_JACCARD, BODY_JACCARD, SHINGLE = 0.8, 0.6, 5
CHUNK_TOKENS, CHUNK_OVERLAP = 500, 1

# --- Fixed values: the company registry ------------------------------------------------------------------
COMPANIES = {
    "AAPL": ("Apple", True, ["Apple", "Apple Inc"], ["iPhone", "iPad", "MacBook", "Apple Intelligence", "Vision Pro", "App Store", "Apple TV"]),
    "MSFT": ("Microsoft", True, ["Microsoft"], ["Azure", "Xbox", "Copilot"]),
    "AMZN": ("Amazon", True, ["Amazon", "Amazon.com"], ["AWS", "Amazon Web Services", "Prime Video", "Alexa", "Kindle"]),
    "NFLX": ("Netflix", True, ["Netflix"], []),
    "NVDA": ("Nvidia", True, ["Nvidia", "NVIDIA"], ["GeForce", "CUDA", "Blackwell"]),
    "INTC": ("Intel", True, ["Intel"], ["Xeon", "Gaudi"]),
    "IBM": ("IBM", True, ["IBM", "International Business Machines"], ["watsonx", "Watson"]),
    "TSLA": ("Tesla", False, ["Tesla"], ["Cybertruck", "Autopilot"]),
    "GOOGL": ("Alphabet (Google)", False, ["Google", "Alphabet", "GOOG"], ["YouTube", "Gemini", "Waymo", "Android"]),
    "META": ("Meta Platforms", False, ["Meta Platforms", "Meta", "Facebook"], ["Instagram", "WhatsApp"]),
    "AMD": ("AMD", False, ["Advanced Micro Devices", "AMD"], []),
    "AVGO": ("Broadcom", False, ["Broadcom"], []),
    "TSM": ("TSMC", False, ["TSMC", "Taiwan Semiconductor"], []),
    "ORCL": ("Oracle", False, ["Oracle"], []),
    "BABA": ("Alibaba", False, ["Alibaba"], []),
}

# --- Fixed values: salience, tiers, tone -----------------------------------------------------------------
TITLE_SUBJECT_WEIGHT, TITLE_WEIGHT, LEAD_WEIGHT, TAGGED_WEIGHT, FREQUENCY_WEIGHT, SHARE_WEIGHT = 0.45, 0.15, 0.10, 0.05, 0.10, 0.25
LEAD_WORDS, FREQUENCY_CAP, FREQUENCY_MIN = 60, 2.0, 2
PRIMARY_THRESHOLD, PRIMARY_BY_TYPE = 0.50, {"listicle": 0.80, "market_wrap": 0.70}
INCIDENTAL_TYPES = ["press_release"]
ENUMERATION_MIN = 8
POSITIVE = "beat beats exceeded surged surge soared soar rallied rally jumped gains gained record raised raises upgrade upgraded outperform strong stronger growth grew profit profitable boost boosted optimistic bullish upside momentum win wins improved".split()
NEGATIVE = "miss missed fell fall plunged plunge slid slump dropped decline declined losses loss cut cuts downgrade downgraded underperform weak weaker struggling struggles risk risks bearish lawsuit layoffs warning concern concerns pressure headwinds".split()
NEGATORS = "not no never without didn't doesn't isn't wasn't hardly".split()
NEGATION_WINDOW, TONE_MIN_HITS, TONE_THRESHOLD, TONE_MIXED_MIN = 3, 3, 0.25, 3
SUFFIXES = ("ing", "ies", "ied", "es", "ed", "s")

# --- Fixed values: article types (label, patterns, whether the lead counts), first match wins ---------------
LEAD_CHARS = 600
ARTICLE_TYPES = [
    ("press_release", [r"\((?:BUSINESS WIRE|PRNewswire|GLOBE NEWSWIRE|ACCESSWIRE|Newsfile)\)", "For Immediate Release", "Market (?:Size )?to (?:Reach|Soar|Grow)", r"\b(?:today announced|announced today)\b"], True),
    ("analyst_note", [r"(?i)\bprice target\b", r"(?i)\b(?:upgrades?|downgrades?)\b.{0,40}\b(?:to|from)\b", r"(?i)\binitiates? coverage\b", r"(?i)\bAnalyst Report:"], False),
    ("market_wrap", [r"(?i)\bMarket Minute\b", r"(?i)\bMorning Brief\b", r"(?i)^Sector Update\b", r"(?i)^Stock Market Today\b", r"(?i)^Equities (?:Mixed|Higher|Lower)\b", r"(?i):\s*Wealth!?$"], False),
    ("listicle", [r"(?i)\b\d+\s+(?:best|top|most|high|cheap|biggest|popular)\b", r"(?i)\bwe recently (?:compiled|published) a list\b", r"(?i)\bAmong the Best\b", r"(?i)\bHighlights\b.*,.*(?:and|&)", r"(?i)\boriginals ever made\b"], True),
    ("opinion", [r"(?i)^Should You\b", r"(?i)^Prediction:", r"(?i)^Where Will\b", r"(?i)^Is .{1,60}\ba Buy\b", r"(?i)^Fade the\b", r"(?i)\bBuy, Sell or Hold\b"], False),
]

# --- Fixed values: events, in output order ------------------------------------------------------------------
EVENTS = {
    "earnings": [r"(?i)\b(?:earnings|EPS|quarterly results|fiscal (?:first|second|third|fourth)[- ]quarter|revenue guidance)\b", r"(?i)\b(?:beat|missed?) (?:estimates|expectations)\b"],
    "analyst_rating": [r"(?i)\b(?:upgrade[sd]?|downgrade[sd]?|reiterate[sd]?|initiate[sd]? coverage)\b", r"(?i)\b(?:overweight|underweight|outperform|underperform|neutral|equal[- ]weight) rating\b", r"(?i)\b(?:buy|sell|hold) rating\b", r"(?i)\banalysts?\b.{0,60}\b(?:say|says|said|expect|expects|argue|argues|recommend)"],
    "price_target": [r"(?i)\bprice targets?\b", r"(?i)\btarget price\b", r"(?i)\bPT\b"],
    "stock_move": [r"(?i)\b(?:shares|stock)\b.{0,40}\b(?:rose|rise|rising|jump(?:ed|s)?|surg(?:e|ed|es|ing)|soar(?:ed|s|ing)?|rall(?:y|ied|ies)|climb(?:ed|s)?|fell|fall(?:s|ing)?|drop(?:ped|s)?|plung(?:e|ed|es)|slid|sink|sank|tumbl(?:e|ed)|skyrocket(?:ing|ed)?|trades? (?:up|down))\b"],
    "product": [r"(?i)\b(?:launch(?:es|ed)?|unveil(?:s|ed)?|introduc(?:es|ed)|new (?:model|chip|iPhone|device|app))\b"],
    "deal": [r"(?i)\b(?:acquir(?:e|es|ed|ing)|acquisition|merger|takeover|buyout|bid for)\b", r"(?i)\b(?:deal|deals) (?:to|with|for)\b", r"(?i)\b(?:split (?:up|the company)|break(?:s|ing)? up|spin[- ]?off|stake in)\b", r"(?i)\b(?:potential|possible|exploring|considering|weighing|reported)\b.{0,30}\b(?:deals?|transactions?|bids?|takeover)\b", r"(?i)\b(?:in talks with|sell(?:ing)? (?:certain |some |its )?(?:assets|units?|business(?:es)?|factories|a stake)|snap(?:ping)? up)\b"],
    "partnership": [r"(?i)\b(?:partner(?:s|ed|ship)? with|collaborat(?:e|es|ion) with|teams up)\b"],
    "legal_regulatory": [r"(?i)\b(?:lawsuit|antitrust|regulator[sy]?|investigation|probe|fined?|settlement|export (?:controls|restrictions))\b"],
    "leadership": [r"(?i)\b(?:appoint(?:s|ed|ment)|resign(?:s|ed|ation)|steps? down|stepped down|ousted|succession)\b", r"(?i)\bnames? .{0,40}\bas (?:its )?(?:new )?(?:CEO|CFO|chief|president|chair)", r"(?i)\b(?:new|interim|former) (?:CEO|chief executive)\b"],
    "macro": [r"(?i)\b(?:inflation|interest rates?|the Fed\b|Federal Reserve|tariffs?|recession|GDP|jobs report)\b"],
}

# --- Fixed values: questions ----------------------------------------------------------------------------------
INTENTS = [
    ("advice", r"\b(should (i|we)|is it (a )?(good|bad|smart|wise)|worth (buying|investing)|(buy|sell|hold|invest in)\b.*\?$|good (buy|investment)|recommend)"),
    ("prediction", r"\b(will .+ (go|rise|fall|drop|climb|increase|decrease|crash|rally|recover)|going to (go|rise|fall|drop)|forecast|predict|outlook for .+ (stock|shares)|where will|expected to (rise|fall)|will .+ (outperform|be the (best|biggest|top)|winners?))"),
    ("live_data", r"\b((current|today'?s|live|latest|real[- ]time) (market cap(italization)?|price|stock price|share price|valuation|quote)|trading at (right )?now|(price|market cap|valuation) right now)\b"),
    ("timing", r"\b(yesterday|today|this (morning|afternoon|week)|last (night|week)|tonight)\b"),
    ("price_target", r"\b(price target|target price|price objective|pt)\b"),
    ("analyst_view", r"\b(analysts?|rating|upgrade|downgrade|wall street (says|thinks)|consensus)\b"),
    ("causal", r"\b(why|what caused|reason|behind the)\b.*\b(jump|surge|soar|rise|rose|rall|fall|fell|drop|plunge|sink|sank|slide|slid|move|moved|up|down|spike)"),
]
LIVE_METRICS = [("market cap", r"market cap|capitali[sz]ation"), ("valuation", "valuation")]
FINANCE = r"\b(stocks?|shares?|equit(y|ies)|market|nasdaq|dow|s&p|index|earnings|revenue|profit|sales|guidance|analysts?|ratings?|upgrade|downgrade|price target|valuation|dividend|buyback|ipo|mergers?|acquisitions?|deals?|investors?|investing|invest|funds?|etf|portfolio|hedge|economy|economic|inflation|interest rates?|fed|tariffs?|sector|industry|compan(y|ies)|ceo|layoffs?|chipmakers?|semiconductors?|trading|traders?|wall street|bull(ish)?|bear(ish)?|rally|sell-?off|news)\b"
TOP_K, PREFETCH_K, FULL_COVERAGE, QUESTION_CHARS = 8, 30, 5, 500
BM25_K1, BM25_B, RRF_K = 1.2, 0.75, 2

# --- Fixed values: notices --------------------------------------------------------------------------------------
NOT_ADVICE = "This is a summary of news coverage, not investment advice. I can't tell you whether to buy or sell, or predict where a stock will go."
NO_DATES = "The articles in this dataset don't carry reliable publication dates, so I can't tell you what happened on a specific day such as yesterday."
NO_GROUNDED_ANSWER = "I couldn't find information in the news articles that answers this question."
OUT_OF_SCOPE = "I can only answer questions about the financial news in this dataset, such as companies, stocks, analyst views, and markets. Try asking about a company like Intel, Apple, or Nvidia."
ANSWER_UNAVAILABLE = "Sorry, I couldn't generate an answer right now. Please try again in a moment."
PARTIAL_SOURCES = "Some of the sources are partial articles (paywalled or teasers), so treat those details as lower-confidence."
FIXED_MESSAGES = [NOT_ADVICE, NO_DATES, NO_GROUNDED_ANSWER, OUT_OF_SCOPE, ANSWER_UNAVAILABLE, PARTIAL_SOURCES]

# --- Fixed values: entities -------------------------------------------------------------------------------------
EXCHANGES = ["NASDAQ", "NYSE", "NYSEARCA", "NYSEAMERICAN", "AMEX", "OTC", "TSX", "LSE"]
NOT_TICKERS = "AI AGI CEO CFO COO CTO DEI ETF ETFS EPS IPO GDP CPI US USA UK EU UN SEC FTC DOJ FDA FCC IRS NYSE NASDAQ Q1 Q2 Q3 Q4 FY YTD YOY TTM PE EV EVS LLM LLMS GPU GPUS CPU CPUS API SAAS IT HR PR TV VR AR PC PCS NFL NBA MLB WSJ CNBC BBC CEOS SMA RSI MACD ROI ROE EBITDA GAAP OSHA DOGE PBS MEA BFSI FMCG SIEM AEC NT DCF ESP NDR EHR EMR AG CAGR IP FCPA ISV TAM HPC ML NLP CDSS ADAS SOC DUV EUV HBM ASP ARR CTE TBI MEA SMA".split()
GENERIC_WORDS = "Software Technologies Technology Systems Industries Foods Brands Networks Semiconductor Pharmaceuticals Therapeutics Financial Energy".split()
NAME_SUFFIXES = "Inc Inc. Corp Corp. Corporation Co Co. Company Ltd Ltd. Limited plc PLC N.V. NV S.A. SA AG SE Holding Holdings Group LLC L.P. Sponsored ADR (The)".split()
LEADING_WORDS = "why how what is are the shares stock stocks buy sell and of at for as like such including while both rival competitor competitors peer peers whereas but however meanwhile also so yet then now today here in on by with from".split()
BARE_MIN_COUNT, LEARNED_MIN_CHARS = 2, 4
#: Formal references, in order of trust: with an exchange, in round brackets, bare. Groups: 1 name, 2 tag, 3 symbol; the tag ends the match.
FORMAL_PATTERNS = {
    "tagged": r"(?:((?:[A-Z][\w.&'-]*\s+){0,4}?[A-Z][\w.&'-]*)\s*)?(\((?:NASDAQ|NYSE|NYSEARCA|NYSEAMERICAN|AMEX|OTC|TSX|LSE)\s*:\s*([A-Z]{1,5}(?:[.-][A-Z])?)\))",
    "paren": r"((?:[A-Z][\w.&'-]*\s+){0,4}?[A-Z][\w.&'-]*)\s*(\(([A-Z]{2,5}(?:\.[A-Z])?)(?:,\s*[A-Z][\w ]{0,20})?\))",
    "bare": r"((?:[A-Z][\w.&'-]*\s+){0,4}?[A-Z][\w.&'-]*)\s+(([A-Z]{2,5}))(?=\s+[a-z]|['’][s ]|[.,;:])",
}
STUB_NOTE = "Note: partial article (paywalled or teaser); treat as low-confidence."

"""Fixed values that results depend on, stated as plain text.

They are constants of the domain model (weights, phrase lists, thresholds), not
tunables; changing one changes results.
"""

from __future__ import annotations

# --- fixed values: bullish phrases and weights -----------------------------
BULL_PHRASES = {
    "to the moon": 3.0, "moon": 1.5, "rip higher": 2.5, "ripping": 2.0, "breakout": 2.0,
    "breaking out": 2.2, "beat estimates": 2.5, "beat": 1.2, "raised guidance": 2.5,
    "guide raised": 2.5, "guidance was a beat": 2.5, "all-time high": 2.0, "new highs": 2.0,
    "record": 1.2, "rally": 1.8, "bullish": 2.5, "calls": 1.0, "calls printing": 3.0,
    "printing": 1.5, "undervalued": 2.0, "cheap": 1.2, "accumulating": 1.8,
    "accumulation": 1.5, "buy the dip": 2.0, "dip was a gift": 2.5, "loading up": 2.0,
    "loaded up": 2.0, "strong hands": 1.5, "diamond hands": 2.0, "not selling": 1.5,
    "squeeze": 1.8, "gamma ramp": 2.0, "shorts are trapped": 2.8,
    "short interest is fuel": 2.5, "executing flawlessly": 2.5, "has legs": 2.0,
    "next leg up": 2.2, "thesis keeps getting stronger": 2.5, "up only": 2.0,
    "outperform": 1.8, "upgrade": 1.8, "upgraded": 1.8, "demand is bottomless": 2.5,
    "backlog at record": 2.2, "paying off": 1.8, "bullish continuation": 2.5,
    "reclaimed": 1.5, "best risk/reward": 2.2, "decoupling is real": 1.5,
    "institutions are here": 1.8, "inflows": 1.5, "leading the charge": 1.8,
    "positioned perfectly": 2.2, "winner": 1.5, "crushing it": 2.2, "underrated": 1.5,
    "quietly at all-time highs": 2.2,
}

# --- fixed values: bearish phrases and weights -----------------------------
BEAR_PHRASES = {
    "puts": 1.2, "puts printing": 3.0, "bearish": 2.5, "crash": 2.5, "rolls over": 2.0,
    "rolling over": 2.0, "breaking down": 2.2, "below support": 2.0, "bear flag": 2.5,
    "rug pull": 2.5, "dump": 1.8, "dumping": 2.0, "insiders dumping": 2.8, "sell off": 2.0,
    "selloff": 2.0, "overvalued": 2.2, "priced for perfection": 2.5, "makes zero sense": 2.0,
    "bagholder": 2.5, "bag holder": 2.5, "wait for the flush": 2.2,
    "margins are getting crushed": 2.8, "margin death spiral": 3.0, "guidance was weak": 2.5,
    "missed estimates": 2.5, "miss": 1.2, "downgrade": 1.8, "downgraded": 1.8,
    "exhausted": 1.8, "euphoric": 1.5, "taking profits": 1.5, "sold all": 2.0,
    "momentum is gone": 2.2, "in trouble": 2.0, "not good": 1.8,
    "numbers don't add up": 2.5, "don't add up": 2.2, "giving back": 1.8,
    "underwhelmed": 2.0, "bulls in denial": 2.5, "softening": 1.5, "cutting prices": 1.5,
    "getting crushed": 2.5, "worry": 1.2, "scam": 2.5, "fraud": 2.8, "drilling": 1.8,
    "tanking": 2.5, "capitulation": 2.0, "short it": 2.2,
}

# --- fixed values: negators and intensifiers -------------------------------
NEGATED = r"(?U)\b(not|no|never|isn't|aren't|won't|don't|doesn't|wasn't)\s+(\w+\s+){0,2}$"
INTENSIFIERS = {"absolutely": 1.4, "insanely": 1.4, "massively": 1.3, "huge": 1.2, "very": 1.15}
NEGATION_FACTOR = -0.8
PREFIX_CHARS = 30
SQUASH = 4.0
LABEL_THRESHOLD = 0.12

# --- fixed values: platform authority --------------------------------------
PLATFORM_AUTHORITY = {
    "sec": 3.0, "rss": 2.5, "finnhub": 2.2, "gdelt": 2.0, "hackernews": 1.5,
    "reddit": 1.3, "stocktwits": 1.0, "bluesky": 0.9, "mastodon": 0.8, "sample": 1.0,
}

# --- fixed values: symbols in texts ------------------------------------------
CASHTAG = r"(?U)\$([A-Za-z][A-Za-z.]{0,5})\b"
BARE_SYMBOL = r"(?U)\b([A-Z][A-Z.]{1,5})\b"
PLAUSIBLE_SYMBOL = "^[A-Z]{2,5}$"

# --- fixed values: symbols that read as ordinary words when bare ------------
AMBIGUOUS_SYMBOLS = (
    "NOW", "NET", "ARM", "ALL", "ANY", "F", "T", "C", "V", "MA", "MS", "GS", "GE", "GM",
    "BA", "KO", "HD", "DIS", "TM", "MU", "SO", "PEP", "CAT", "LINK", "PEPE", "GLD", "DASH",
    "SHOP", "SQ", "IT", "ON", "DOGE",
)

# --- fixed values: coins quoted as <COIN>-USD pairs -------------------------
COINS = ("BTC", "ETH", "SOL", "DOGE", "XRP", "ADA", "AVAX", "LINK", "SHIB", "PEPE")

# --- fixed values: filing form -> sentence tail -----------------------------
FILING_BLURBS = {
    "8-K": "filed an 8-K (material corporate event)",
    "4": "reported an insider transaction (Form 4)",
}

# --- fixed values: vocabulary stopwords -------------------------------------
STOPWORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been", "before",
    "being", "but", "by", "can", "could", "did", "do", "does", "for", "from", "had", "has", "have", "he",
    "her", "his", "how", "i", "if", "in", "into", "is", "it", "its", "just", "like", "me", "more", "most",
    "my", "no", "not", "now", "of", "on", "one", "or", "our", "out", "over", "so", "some", "than", "that",
    "the", "their", "them", "then", "there", "these", "they", "this", "to", "up", "us", "was", "we", "were",
    "what", "when", "which", "who", "will", "with", "would", "you", "your", "yours", "im", "dont", "thats",
    "whats", "theres",
)

# --- fixed values: topics ---------------------------------------------------
TOPIC_SERIES_HOURS = 72
TOPIC_BUCKET_HOURS = 3
TOPIC_MIN_POSTS = 50
TOPIC_MIN_MEMBERS = 28
TOPIC_MEMBER_SHARE = 55
BIGRAM_BOOST = 1.6
TREND_RATIO = 1.3

# --- fixed values: field names accepted by the file loader ------------------
FIELD_ALIASES = {
    "text": ("text", "body", "title", "content", "message", "selftext"),
    "author": ("author", "user", "username", "screen_name"),
    "timestamp": ("timestamp", "created_at", "created_utc", "date", "time"),
    "engagement": ("engagement", "score", "ups", "likes", "upvotes", "points"),
    "url": ("url", "permalink", "link"),
    "platform": ("platform", "source_platform", "site"),
    "source": ("source", "subreddit", "feed", "channel"),
    "id": ("id", "post_id", "uid"),
    "tickers": ("tickers", "symbols", "cashtags"),
    "lang": ("lang", "language"),
}

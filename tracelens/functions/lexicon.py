"""Word lists, patterns and constants on which results depend."""

# Stop words, polarity words, suffixes, synonyms, patterns.
STOPWORDS = """
a an and are as at be been but by can could did do does doing don for from had has
have having he her here hers him his how i if in into is it its just me my no nor not
of on or our ours out over own same she should so some such than that the their them
then there these they this those to too under until up very was we were what when
where which while who whom why will with would you your yours am been being
""".split()

POLARITY = ["not", "no", "never", "without", "excluding", "except", "unless", "non"]

DEICTIC = ["it", "that", "this", "they", "them", "those", "these", "there", "its", "one"]

SUFFIXES = [
    ("ization", "ize"), ("izations", "ize"), ("iness", "y"), ("ingly", ""), ("edly", ""), ("tions", "t"),
    ("tion", "t"), ("sions", "s"), ("sion", "s"), ("ments", "ment"), ("ness", ""), ("ing", ""),
    ("ers", "er"), ("ies", "y"), ("ied", "y"), ("ed", ""), ("es", ""), ("s", ""),
]

SYNONYMS = {
    "delete": "remove", "erase": "remove", "drop": "remove", "purge": "remove", "evict": "remove",
    "turn-off": "disable", "switch-off": "disable", "deactivate": "disable", "turn-on": "enable", "activate": "enable",
    "config": "configuration", "conf": "configuration", "param": "parameter", "parameters": "parameter", "arg": "parameter",
    "opt": "option", "setting": "option", "flag": "option", "doc": "documentation", "docs": "documentation",
    "db": "database", "mem": "memory", "ram": "memory", "err": "error", "fail": "failure", "failing": "failure",
    "broken": "failure", "speed": "performance", "fast": "performance", "faster": "performance", "slow": "performance",
    "latency": "performance", "persist": "persistence", "durable": "persistence", "durability": "persistence",
    "replica": "replication", "secondary": "replica", "standby": "replica", "index": "indexing", "indexes": "indexing",
    "indices": "indexing", "vector": "vector", "embedding": "vector", "shard": "sharding", "partition": "sharding",
    "backup": "snapshot", "dump": "snapshot", "restore": "recovery", "recover": "recovery", "limit": "limit",
    "cap": "limit", "threshold": "limit", "max": "limit", "maximum": "limit", "timeout": "timeout", "expire": "expiry",
    "ttl": "expiry", "auth": "authentication", "login": "authentication", "credential": "authentication",
    "tune": "tuning", "throttle": "throttling", "throttled": "throttling", "rate-limit": "throttling",
}

TOKEN = r"[A-Za-z_][A-Za-z0-9_.\-]*[A-Za-z0-9_]|[A-Za-z]|\d+(?:\.\d+)+|\d+"
NUMBER = r"\b\d[\d,._]*\b"
# What an identifier, a fence, a paragraph's and a sentence's end, a word of prose and a list mark look like.
IDENTIFIER = r"^(?=.*[A-Za-z])(?=.*[0-9_.\-])[A-Za-z0-9_.\-]+$|^[0-9]+(?:\.[0-9]+)+$"
FENCED = r"(?s)```.*?```"
PARAGRAPH_END = r"\n[ \t]*\n"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z(`\[])"
PROSE_WORD = "[A-Za-z]{2,}"
TERMINAL = r"[.!?]$"
LIST_MARK = r"^\s*(?:[-*+]\s+|\d+[.)]\s+|#{1,6}\s+|>\s+|\|)"
CITED = r"\[(\d+(?:\s*,\s*\d+)*)\]"
SCORED = r"(\d+)\s*[:=]\s*(\d+(?:\.\d+)?)"
THOUGHT = r"(?is)<think>.*?</think>"

REFUSAL = [
    r"\b(?:do|does|did)(?:\s+not|n't)\s+(?:\w+\s+){0,2}(?:state|say|specify|document|mention|rank|list|provide|indicate|contain|include|address|appear|exist)",
    r"\b(?:is|are|was|were)\s+(?:not|never)\s+(?:\w+\s+){0,2}(?:documented|specified|stated|mentioned|listed|defined|described|available|covered|found|supported)",
    r"\bno\s+(?:\w+\s+){0,2}(?:such|benchmark|evidence|documentation|mention|information|reference|indication|record|setting|option)",
    r"\b(?:cannot|can\s?not|could\s?not|couldn't|can't|unable\s+to|not\s+able\s+to)\s+(?:\w+\s+){0,2}(?:find|determine|answer|verify|say|tell|confirm|establish)",
    r"\bnot\s+(?:explicitly\s+|directly\s+|clearly\s+)?(?:documented|specified|stated|mentioned|available|covered|found|described|defined)",
    r"\b(?:i|we)\s+(?:do\s+not|don't)\s+have\s+(?:enough|sufficient|any)\b",
    r"\bnot\s+enough\s+(?:information|evidence|detail|context)\b",
    r"\boutside\s+the\s+(?:retrieved|provided|available)\s+(?:documents|sources|context)\b",
]

HEDGE = [
    r"\b(?:may|might|could)\s+not\b",
    r"\bit\s+(?:may|might|could)\s+be\b",
    r"\b(?:appears|seems)\s+to\b",
    r"\b(?:is|are)\s+unclear\b",
    r"\bnot\s+(?:certain|clear|conclusive)\b",
    r"\b(?:possibly|presumably|ostensibly)\b",
    r"\b(?:suggests|implies)\s+that\b",
    r"\blikely\s+(?:that|to)\b",
    r"\bhowever,?\s+the\s+sources\b",
    r"\bbased\s+only\s+on\b",
]

#: USD for a million tokens in and out; names are placeholders of price classes.
PRICES = {"simulated": (0.0, 0.0), "small": (0.05, 0.08), "large": (0.59, 0.79)}

"""Word lists, lookup tables and constants that results depend on."""

# Title stop words.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "he", "her", "his", "how", "i", "in", "is", "it", "its",
    "of", "on", "or", "our", "she", "that", "the", "their", "them", "they", "this", "to", "was", "we", "were", "what", "when", "where", "which",
    "who", "why", "will", "with", "you", "your",
)

# Topics and their keywords.
TOPICS = {
    "general": ("technology", "tech", "software", "hardware", "internet"),
    "ai": ("ai", "artificial intelligence", "llm", "chatgpt", "openai", "anthropic", "gemini", "machine learning"),
    "startups_vc": ("startup", "seed", "series a", "series b", "funding", "venture", "vc", "valuation", "acquired"),
    "frontend": ("react", "next.js", "nextjs", "frontend", "ui", "css", "tailwind", "typescript", "javascript"),
    "backend": ("kubernetes", "k8s", "postgres", "database", "backend", "infra", "devops", "docker", "microservices"),
    "devtools": ("devtools", "developer tools", "sdk", "cli", "open source", "github", "release", "launch"),
    "security": ("security", "breach", "vulnerability", "cve", "ransomware", "phishing", "zero-day", "exploit"),
    "hardware_gpu": ("gpu", "nvidia", "amd", "intel", "semiconductor", "chip", "foundry", "euv", "supply chain"),
    "robotics": ("robot", "robotics", "humanoid", "automation", "warehouse robot", "drone", "autonomous"),
    "policy": ("regulation", "policy", "law", "antitrust", "congress", "eu", "gdpr", "ai act"),
    "data": ("data", "privacy", "dataset", "analytics", "telemetry", "tracking", "observability", "logging"),
}

# Keywords of social topics.
SOCIAL_TOPICS = {
    "ai": ("llm", "agent", "openai", "anthropic", "gpt", "foundation model", "alignment", "inference"),
    "startups": ("startup", "founder", "seed", "series a", "demo day", "venture", "vc", "incubator"),
    "frontend": ("react", "next.js", "vite", "typescript", "css", "tailwind", "frontend"),
    "backend": ("api", "backend", "database", "postgres", "kubernetes", "microservices", "grpc"),
    "devtools": ("devtools", "cli", "ide", "observability", "ci", "cd", "debugger"),
    "security": ("cve", "breach", "vuln", "exploit", "zero-day", "security"),
    "hardware": ("gpu", "nvidia", "cuda", "chip", "semiconductor", "hardware", "accelerator"),
    "robotics": ("robotics", "robot", "automation", "humanoid", "actuator"),
    "data": ("data", "mlops", "warehouse", "vector db", "analytics", "etl"),
    "policy": ("regulation", "policy", "ai act", "antitrust", "privacy law", "compliance"),
    "design": ("design system", "ux", "product design", "typography", "interaction"),
    "product": ("product", "roadmap", "growth", "retention", "metrics", "pm"),
}

# Canonical tags, in rank order, and what else maps to them.
HIGH_SIGNAL_TAGS = ("AI", "Startups", "Product", "Design", "Security", "Data", "Policy", "Climate", "Health", "Finance", "Crypto", "Robotics", "Hardware", "Space", "Media", "Education", "Cloud", "Mobile")
TAG_SYNONYMS = {
    "ai": "AI", "artificial intelligence": "AI", "machine learning": "AI", "ml": "AI", "llm": "AI", "llms": "AI", "genai": "AI", "generative ai": "AI", "openai": "AI", "chatgpt": "AI", "gpt": "AI", "gpt-4": "AI", "gpt-5": "AI",
    "startup": "Startups", "startups": "Startups", "founders": "Startups", "entrepreneurship": "Startups", "venture capital": "Startups", "vc": "Startups",
    "product": "Product", "product management": "Product",
    "design": "Design", "ux": "Design", "ui": "Design",
    "security": "Security", "cybersecurity": "Security", "privacy": "Security",
    "data": "Data", "data science": "Data", "analytics": "Data",
    "policy": "Policy", "regulation": "Policy", "government": "Policy", "geopolitics": "Policy",
    "climate": "Climate", "energy": "Climate", "sustainability": "Climate",
    "health": "Health", "biotech": "Health", "medicine": "Health",
    "finance": "Finance", "fintech": "Finance", "markets": "Finance", "economy": "Finance",
    "crypto": "Crypto", "blockchain": "Crypto", "web3": "Crypto",
    "robotics": "Robotics", "automation": "Robotics",
    "hardware": "Hardware", "semiconductors": "Hardware", "chips": "Hardware",
    "space": "Space",
    "media": "Media", "journalism": "Media", "misinformation": "Media",
    "education": "Education", "edtech": "Education",
    "cloud": "Cloud", "aws": "Cloud", "amazon web services": "Cloud", "azure": "Cloud", "gcp": "Cloud", "google cloud": "Cloud", "kubernetes": "Cloud", "devops": "Cloud", "infrastructure": "Cloud",
    "ios": "Mobile", "android": "Mobile", "mobile": "Mobile", "app store": "Mobile", "play store": "Mobile",
}
TOKEN_TAGS = {
    "ai": "AI", "llm": "AI", "openai": "AI", "startups": "Startups", "founder": "Startups", "product": "Product", "design": "Design", "security": "Security", "privacy": "Security",
    "frontend": "Frontend", "backend": "Backend", "devtools": "DevTools", "dev": "DevTools", "data": "Data", "policy": "Policy", "robotics": "Robotics", "hardware": "Hardware",
}

# Words of a stance, and how each stance frames.
SKEPTICAL = ("fails", "failure", "concern", "criticism", "critic", "lawsuit", "backlash", "risk", "ban", "warn", "probe", "investigation", "breach", "vulnerability", "exploit", "decline", "cut", "layoff", "miss")
OPTIMISTIC = ("launch", "release", "breakthrough", "wins", "growth", "record", "raises", "funding", "approval", "clears", "acquires", "ships", "expands")
FRAMINGS = {
    "skeptical": "Emphasizes risks, caveats, or unresolved questions.",
    "mainstream": "Highlights the core announcement and immediate implications.",
    "balanced": "Balances key facts with context and constraints.",
}

# Framing lenses, and the texts that stand for a missing trust analysis.
LENSES = ("product launch", "market competition", "security risk", "policy/regulation", "business strategy", "human impact", "science/engineering", "opinion/analysis")
PLACEHOLDERS = {
    "whats_missing": ("More detail and stakeholder context are not provided in the summary.", "Missing details and stakeholders until enrichment runs."),
    "near_term": ("Near-term implications are unclear from the limited text.", "Implications not yet assessed."),
    "long_term": ("Long-term implications are unclear from the limited text.", "Long-term effects not yet assessed."),
    "emphasis": ("Focuses on headline without depth.", "Focuses on headline claims."),
    "downplays": ("Tradeoffs, risks, and stakeholder impacts.", "Tradeoffs and limitations not covered."),
    "language_notes": ("Neutral or generic tone.", "Neutral tone."),
}

# Source names that lift a group.
BOOSTED_SOURCES = (
    "reuters", "associated press", "ap", "bloomberg", "financial times", "ft", "wall street journal", "wsj", "the verge", "techcrunch", "engadget", "wired", "bbc", "guardian", "nytimes", "new york times",
    "a16z", "andreessen", "accel", "sequoia", "greylock", "bessemer", "usv", "union square ventures", "lightspeed", "index ventures", "insight partners", "coatue", "redpoint", "benchmark", "khosla",
    "first round", "signal", "founders fund", "nfx", "y combinator", "yc",
)

# Query parameters that a canonical URL drops, beside those that start with utm_.
TRACKING_PARAMETERS = ("ref", "source", "feature")
# Terms that block an item by default, tags that don't inform clustering, source types.
BLOCKED_TERMS = ("deal", "discount", "coupon", "sale")
STOP_TAGS = ("ai", "general", "frontend", "devtools", "data")
SOURCE_TYPES = ("primary", "editorial", "community", "social", "vc_blog", "aggregator")
# Topics and parts of a rumor or of a statement that hedges.
RUMOR_WORDS = ("rumor", "rumour", "leak", "reportedly")
HEDGE_WORDS = ("could", "might", "possible")

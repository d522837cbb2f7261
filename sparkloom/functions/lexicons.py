"""Default word lists; every operator takes its own tables in their place.

All lists are fixed values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAME_SKIP_WORDS = "The This That These Those What When Where Why How After Before During While With From Into About Until Since".split()

ORGS = [
    "White House", "Federal Reserve", "European Union", "United Nations", "World Bank", "IMF", "NATO", "Pentagon", "Congress", "Senate",
    "Supreme Court", "House of Representatives", "State Department", "Department of Defense", "Treasury Department", "Wall Street",
    "Silicon Valley", "OpenAI", "Google", "Microsoft", "Apple", "Amazon", "Meta", "Tesla", "NVIDIA", "Intel", "TSMC", "Samsung",
]
LOCATIONS = [
    "United States", "China", "Russia", "Ukraine", "Iran", "Israel", "Europe", "Middle East", "Washington", "Moscow", "Beijing",
    "London", "Tokyo", "New York", "California", "Texas",
]

# In order of rank: ties between sectors go to the earlier one.
SECTOR_KEYWORDS = {
    "politics": ["government", "parliament", "election", "senate", "minister", "president", "policy", "legislation", "diplomat", "sanction", "treaty", "vote", "campaign"],
    "finance": ["market", "stock", "inflation", "trade", "tariff", "gdp", "recession", "bank", "interest rate", "fiscal", "monetary", "investment", "ipo", "hedge fund"],
    "technology": ["ai", "artificial intelligence", "semiconductor", "chip", "software", "cloud", "quantum", "cyber", "startup", "5g", "gpu", "algorithm", "platform"],
    "energy": ["oil", "gas", "renewable", "solar", "nuclear", "coal", "electricity", "carbon", "climate", "hydrogen", "lithium", "crude", "opec", "ev"],
    "military": ["defense", "military", "army", "navy", "missile", "drone", "weapon", "conflict", "troop", "nuclear weapon", "cyber attack", "intelligence", "spy"],
    "startups": ["startup", "founder", "funding", "venture capital", "vc", "seed round", "series a", "unicorn", "valuation", "entrepreneur", "acquisition"],
    "social": ["protest", "movement", "human rights", "inequality", "healthcare", "education", "discrimination", "justice", "misinformation", "privacy"],
    "global_events": ["earthquake", "flood", "pandemic", "disaster", "crisis", "summit", "ceasefire", "referendum", "trade war", "sanction"],
}
SECTOR_ORGS = {
    "politics": ["senate", "congress", "parliament", "ministry", "commission"],
    "finance": ["fed", "imf", "world bank", "nasdaq", "jpmorgan", "goldman"],
    "technology": ["google", "microsoft", "apple", "nvidia", "intel", "tsmc", "openai"],
    "energy": ["opec", "shell", "bp", "exxon", "reliance", "adani"],
    "military": ["pentagon", "nato", "united nations", "interpol"],
    "startups": ["sequoia", "a16z", "y combinator", "softbank"],
    "social": ["united nations", "who", "red cross", "amnesty"],
    "global_events": ["united nations", "wto", "g7", "g20", "eu", "brics"],
}

DOWNSTREAM_EFFECTS = [
    ("politics", "finance", ["Market volatility index changes", "Currency fluctuation risk", "Sector-specific regulatory impact"]),
    ("politics", "technology", ["Regulatory compliance costs shift", "R&D investment reallocation", "International tech competition dynamics"]),
    ("technology", "energy", ["Energy grid modernization acceleration", "EV adoption rate changes", "Data center energy demand shift"]),
    ("finance", "technology", ["Venture capital reallocation", "IPO market activity shift", "Tech sector valuation adjustments"]),
    ("energy", "military", ["Supply chain security adjustments", "Strategic resource allocation", "Alliance realignment"]),
    ("social", "politics", ["Policy priority shifts", "Election outcome influence", "Regulatory timeline acceleration"]),
]


def gazetteer_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, "orgs") for n in ORGS] + [(n, "locations") for n in LOCATIONS], "name string, etype string")


def sector_keyword_table(spark: SparkSession) -> DataFrame:
    rows = [(s, i, w, "keyword") for i, (s, words) in enumerate(SECTOR_KEYWORDS.items()) for w in words]
    rows += [(s, i, w, "org") for i, (s, words) in enumerate(SECTOR_ORGS.items()) for w in words]
    return spark.createDataFrame(rows, "sector string, rank int, keyword string, kind string")


def downstream_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOWNSTREAM_EFFECTS, "p1 string, p2 string, effects array<string>")

"""Fixed values of the data model."""

from __future__ import annotations

# Enumerations (fixed values).
SYSTEMS = ["high_risk_regulated", "general_purpose_model", "autonomous_agent", "biometric_identification", "critical_infrastructure_component", "dual_use_security", "unclassified"]
LIFECYCLES = ["design_and_training", "testing_and_validation", "deployment_and_integration", "operation_and_monitoring", "decommissioning"]
ROOT_CAUSES = ["data", "model", "human", "governance", "external", "undetermined"]
HARM_DOMAINS = ["persons_physical", "persons_mental", "persons_rights", "property", "environment", "systemic_integrity", "societal"]
TEMPORALITIES = ["actual", "potential", "latent"]
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
INTENTS = ["intentional_misuse", "unintentional_failure"]
PURPOSES = ["generative_content", "autonomous_mobility", "biometric_surveillance", "financial_fintech", "healthcare_medical", "recruitment_hr", "defense_national_security", "content_recommendation", "other"]
HARM_TYPES = ["discrimination_bias", "privacy_breach", "physical_safety", "misinformation", "economic_labor", "copyright_ip", "psychological_harm", "national_security"]
EU_TIERS = ["prohibited", "high_risk", "limited_risk", "minimal_risk"]
NIST = ["GOVERN", "MAP", "MEASURE", "MANAGE"]
ISO = ["Internal_Governance", "Data_&_Resources", "System_Impact", "Operational_Security"]
RELATIONS = ["causal_precursor", "evolved_from", "related_cause", "lawsuit_action", "regulatory_action"]
MACRO_SCOPE, DISCRETE_SCOPE, DEFAULT_SOURCE = "cumulative_macro_trend", "discrete_incident", "google_news_rss"
MACRO_USD = 5_000_000_000

# Region keys and the places they stand for (fixed values).
REGIONS = [
    ("united states", "United States", 37.0902, -95.7129),
    ("usa", "United States", 37.0902, -95.7129),
    ("us", "United States", 37.0902, -95.7129),
    ("canada", "Canada", 56.1304, -106.3468),
    ("united kingdom", "United Kingdom", 55.3781, -3.4360),
    ("uk", "United Kingdom", 55.3781, -3.4360),
    ("france", "France", 46.2276, 2.2137),
    ("germany", "Germany", 51.1657, 10.4515),
    ("european union", "European Union", 50.8503, 4.3517),
    ("eu", "European Union", 50.8503, 4.3517),
    ("china", "China", 35.8617, 104.1954),
    ("japan", "Japan", 36.2048, 138.2529),
    ("india", "India", 20.5937, 78.9629),
    ("south korea", "South Korea", 35.9078, 127.7669),
    ("australia", "Australia", -25.2744, 133.7751),
    ("brazil", "Brazil", -14.2350, -51.9253),
    ("south africa", "South Africa", -30.5595, 22.9375),
    ("russia", "Russia", 61.5240, 105.3188),
    ("spain", "Spain", 40.4637, -3.7492),
    ("taiwan", "Taiwan", 23.6978, 120.9605),
    ("israel", "Israel", 31.0461, 34.8516),
    ("global", "Global / Multi-Region", 20.0, 0.0),
]

# Words that tokenising leaves out (fixed values).
STOPWORDS = [
    "the", "and", "for", "that", "with", "from", "this", "have", "were", "been", "about", "after", "used", "using", "over", "into", "incidents", "incident", "report", "news",
    "says", "said", "will", "also", "their", "which", "other", "more", "some", "such", "when", "what", "where", "how", "than", "them", "these", "ai", "system", "model",
    "models", "artificial", "intelligence", "data", "user", "users", "company", "first", "resulting", "tools", "tool", "agent", "agents",
]

# Parties too general to link two events (fixed values).
GENERIC_PARTIES = ["unknown", "public", "general public", "users", "consumers", "openai", "anthropic", "google", "microsoft", "meta", "xai", "deepseek"]

# Query parameters that normalised URLs lose (fixed values).
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "fbclid", "gclid"]

# Words of a macro trend (fixed values).
MACRO_WORDS = [
    "annual report", "chainalysis", "interpol", "global losses", "across industry", "industry report",
    "trm labs", "certik", "first half of", "second half of", "half of 20", "stole during", "stolen during",
    "stole in 20", "stolen in 20", "total losses", "total theft", "multiple incidents", "incidents causing",
    "insiden peretasan", "pencurian aset", "66% of global", "global digital asset",
]

# Patterns of instructions planted in text (fixed values).
INJECTIONS = [
    r"\[\s*system\s*(override|instruction|prompt)\s*\]",
    r"ignore\s+(all\s+)?(previous|prior)\s+(instructions|prompts|directives)",
    r"forget\s+(all\s+)?(previous|prior)\s+instructions",
    r"you\s+are\s+now\s+a\s+different\s+model",
    r"set\s+(is_ai_incident|financial_damage_usd|severity)\s*=",
    r"new\s+system\s+prompt",
    r"disregard\s+above",
]
REDACTED = "[REDACTED_INJECTION_ATTEMPT]"

# Words left out of short search queries (fixed values).
QUERY_STOPWORDS = ["and", "the", "for", "over", "with", "from", "report"]

# Words left out of the entities of a text (fixed values).
ENTITY_STOPWORDS = [
    "the", "and", "for", "that", "with", "from", "this", "have", "were", "been", "about", "after", "used", "using", "over", "into", "incidents", "incident", "report", "news",
    "says", "said", "will",
]

# Rule for financial damage without a stated amount, in order: words, amounts for critical, high and others, name (fixed values).
DAMAGE_RULES = [
    (["fatality", "fatal", "death", "killed", "loss of life"], 12_500_000, 12_500_000, 12_500_000, "vsl_benchmark"),
    (["lawsuit", "class action", "sues", "csam", "copyright", "trade secret"], 12_500_000, 4_500_000, 1_200_000, "statutory_formula"),
    (["scam", "fraud", "crypto", "deepfake", "phishing"], 6_800_000, 2_500_000, 500_000, "empirical_estimate"),
    (["breach", "hack", "intrusion", "vulnerability", "exploit", "rogue", "sandbox"], 4_880_000, 2_500_000, 450_000, "cyber_breach_report"),
    (["dismissal", "court", "prosecuted", "bias", "discrimination", "fcc", "ban"], 5_000_000, 2_500_000, 280_000, "regulatory_turnover"),
]

# Phrases of the adapter's templated texts, one for each branch of the rules (fixed values).
PHRASES = ["$1.5 billion settlement", "lost $3 million", "pedestrian killed", "class action lawsuit", "deepfake scam", "data breach", "hiring bias ruling", "model drift", "policy review", "interpol annual report", "latest release"]

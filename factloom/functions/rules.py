"""Keyword rules: whole words in lower case, in their order."""

# Signal rules (field, value, keywords), in order.
SIGNALS = (
    ("stage", "idea", ("idea stage", "concept stage", "prototype")),
    ("stage", "pre_seed", ("pre-seed", "pre seed")),
    ("stage", "seed", ("seed round", "seed funding")),
    ("stage", "series_a", ("series a",)),
    ("industry", "healthcare", ("healthcare", "hospital", "clinic", "patient", "medical", "diagnostic")),
    ("industry", "semiconductor", ("semiconductor", "soc", "asic", "chip", "risc-v", "silicon", "fabless", "integrated circuit", "microcontroller", "microprocessor")),
    ("industry", "fintech", ("fintech", "payment", "bank", "upi")),
    ("business_models", "saas", ("subscription", "saas", "annual recurring revenue")),
    ("business_models", "marketplace", ("marketplace", "buyer", "seller")),
    ("business_models", "hardware", ("hardware", "hardware product", "hardware platform", "embedded hardware", "embedded system", "semiconductor product")),
    ("business_models", "b2b", ("enterprise", "business customers", "b2b")),
    ("business_models", "b2c", ("consumer", "end users", "b2c")),
    ("technologies", "ai", ("artificial intelligence", "machine learning", "generative ai", "llm", "ai", "edge ai", "ai inference", "edge inference", "neural network", "deep learning")),
    ("technologies", "computer_vision", ("computer vision", "vision model", "vision ai", "ai vision", "video analytics", "image processing", "visual inference", "video intelligence")),
    ("technologies", "iot", ("iot", "internet of things")),
    ("geographies", "india", ("india", "bangalore", "bengaluru")),
    ("geographies", "usa", ("usa", "united states", "california")),
    ("markets", "enterprise", ("enterprise",)),
    ("markets", "consumer", ("consumer",)),
    ("markets", "surveillance", ("surveillance", "video surveillance", "security camera", "security cameras", "cctv")),
    ("themes", "deeptech", ("deep tech", "deeptech")),
    ("themes", "ai", ("artificial intelligence", "generative ai", "llm")),
    ("themes", "edge_ai", ("edge ai", "edge inference", "on-device ai", "on device ai")),
    ("themes", "surveillance", ("surveillance", "video surveillance", "security camera", "cctv")),
)
#: Rules whose keywords do not count right after a negation.
GUARDED = {("business_models", "b2c"), ("markets", "consumer")}
# Risk rules (field, value, severity, keywords), in order.
RISKS = (
    ("founder_risks", "solo_founder", "high", ("solo founder", "single founder", "founder dependency", "founder concentration", "key person dependency", "key-person dependency")),
    ("founder_risks", "first_time_founder", "high", ("first time founder", "first-time founder")),
    ("financial_risks", "high_burn", "high", ("high burn rate", "burn rate is high", "elevated burn", "high burn", "burn rate")),
    ("financial_risks", "low_runway", "high", ("runway 6 months", "less than 6 months runway", "less than six months runway", "runway is less than 6 months", "limited runway", "low runway")),
    ("financial_risks", "pre_revenue", "medium", ("pre revenue", "pre-revenue", "no revenue")),
    ("execution_risks", "prototype_stage", "high", ("prototype", "proof of concept", "poc")),
    ("execution_risks", "hiring_dependency", "medium", ("key hires", "hiring plan", "critical hires", "hiring dependency", "dependent on hiring")),
    ("market_risks", "high_competition", "high", ("competitive market", "strong competition", "highly competitive market", "intense competition", "significant competition")),
    ("market_risks", "customer_concentration", "high", ("single customer", "single-customer dependency", "customer concentration", "high customer concentration", "revenue depends on a single customer", "revenue concentrated in one customer", "revenue is highly concentrated in one customer", "revenue is concentrated in one major customer")),
    ("technology_risks", "unproven_technology", "high", ("experimental", "experimental technology", "unproven", "unproven technology", "technology not yet validated", "not yet validated", "still validating its technology")),
    ("technology_risks", "manufacturing_dependency", "high", ("single foundry", "single-source foundry", "single foundry dependency", "manufacturing dependency", "manufacturing partner", "depends on a single foundry", "dependent on a single foundry", "depends on a manufacturing partner", "dependent on a manufacturing partner")),
    ("legal_risks", "patent_pending", "high", ("patent pending", "patents pending")),
    ("legal_risks", "regulatory_approval", "high", ("fda", "cdsco", "regulatory approval", "regulatory approval required", "regulatory clearance", "regulatory approval pending")),
)
# Document classes and the substrings that speak for them, in order.
CLASSES = (
    ("pitch_deck", ("problem", "solution", "market", "traction", "business model", "go-to-market", "competition", "team", "ask")),
    ("business_plan", ("executive summary", "marketing strategy", "operations", "financial projections")),
    ("financial_model", ("revenue forecast", "cash flow", "income statement", "balance sheet", "ebitda")),
    ("term_sheet", ("term sheet", "liquidation preference", "drag along", "tag along", "anti dilution")),
    ("shareholders_agreement", ("shareholders agreement", "sha", "board composition", "reserved matters")),
    ("cap_table", ("cap table", "shareholding", "equity", "ownership", "fully diluted")),
    ("investor_update", ("monthly update", "quarterly update", "highlights", "key metrics")),
)
# Keyword stop words.
STOP_WORDS = "the and for with from this that have will your into their about page document company".split()
SIGNAL_LISTS = ("business_models", "technologies", "geographies", "markets", "themes", "industry")
RISK_LISTS = ("founder_risks", "financial_risks", "execution_risks", "market_risks", "technology_risks", "legal_risks")
# What negates the keyword that follows it.
NEGATED = r"(?:\bnot\s+(?:a\s+|an\s+|the\s+|primarily\s+)?|\b(?:rather\s+than|instead\s+of|versus|vs\.?)\s+(?:a\s+|an\s+)?)$"

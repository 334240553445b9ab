"""Default lexicons.  Every operator takes its terms as a parameter; these are the defaults."""

# Word lists that results depend on.
AGRI_TERMS = (
    "agriculture", "farming", "agricultural", "farm", "crop", "crops", "soil", "irrigation", "fertilizer", "pesticide", "herbicide", "harvest",
    "cultivation", "livestock", "cattle", "poultry", "kharif", "rabi", "zaid", "monsoon", "paddy", "wheat", "rice", "millet", "pulses", "oilseeds",
    "sugarcane", "cotton", "kisan", "farmer", "grameen", "krishi", "agronomy", "horticulture", "sericulture", "apiculture", "aquaculture",
    "pisciculture", "floriculture", "organic farming", "sustainable agriculture", "precision agriculture", "yield", "production", "productivity",
    "land", "arable", "agri-tech", "agritech", "food security", "rural", "plantation", "orchard", "greenhouse", "nursery",
)
FARM_TERMS = (
    "farming", "tillage", "plowing", "ploughing", "sowing", "transplanting", "harvesting", "threshing", "winnowing", "tractor", "combine", "plough",
    "harrow", "seed drill",
)
REGION_TERMS = (
    "punjab", "haryana", "uttar pradesh", "up", "madhya pradesh", "mp", "rajasthan", "gujarat", "maharashtra", "karnataka", "tamil nadu",
    "andhra pradesh", "telangana", "kerala", "odisha", "west bengal", "bihar", "jharkhand", "chhattisgarh", "assam", "himachal pradesh",
    "uttarakhand", "delhi", "goa", "indo-gangetic", "deccan", "western ghats", "eastern ghats",
)
STATES = (
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana", "himachal pradesh", "jharkhand",
    "karnataka", "kerala", "madhya pradesh", "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "punjab", "rajasthan",
    "sikkim", "tamil nadu", "telangana", "tripura", "uttar pradesh", "uttarakhand", "west bengal",
)
CROPS = (
    "rice", "wheat", "cotton", "sugarcane", "maize", "bajra", "jowar", "ragi", "pulses", "gram", "tur", "lentil", "groundnut", "soybean", "mustard",
    "sunflower", "tea", "coffee", "rubber", "coconut", "cardamom", "pepper", "turmeric", "ginger", "mango", "banana", "potato", "onion", "tomato",
    "chili", "garlic", "coriander",
)
SOILS = ("black soil", "red soil", "alluvial soil", "laterite soil", "sandy soil", "clay soil", "loamy soil")
CLIMATES = ("tropical", "temperate", "arid", "semi-arid", "monsoon", "rainfall", "drought")
FERTILIZERS = ("urea", "dap", "potash", "nitrogen", "phosphorus", "potassium", "compost", "manure")
SPECIES = ("varieties", "cultivars", "hybrid", "indigenous", "high yielding", "drought resistant")
METHODS = ("organic", "precision", "sustainable", "integrated", "conservation", "drip irrigation")
TAGS = {
    "soil": ("soil", "fertility", "nutrients", "organic matter"),
    "irrigation": ("irrigation", "water", "drip", "sprinkler"),
    "climate": ("climate", "weather", "monsoon", "drought"),
    "technology": ("technology", "precision", "digital", "smart"),
    "policy": ("policy", "government", "scheme", "subsidy"),
    "organic": ("organic", "sustainable", "bio", "natural"),
    "pest": ("pest", "disease", "protection", "ipm"),
}
PDF_TAGS = {**TAGS, "breeding": ("breeding", "varieties", "genetics", "selection"), "economics": ("economics", "cost", "profit", "income", "market")}
RELEVANCE_TERMS = ("agriculture", "farming", "crop", "cultivation", "harvest", "soil", "irrigation")
PLACE_TERMS = ("india", "indian", "bharatiya")
SATURATING_TERMS = ("agriculture", "farming", "crop", "plant", "soil", "irrigation", "fertilizer", "pest", "disease", "yield", "cultivation", "harvest")
CONTEXT_TERMS = ("india", "indian", "bharatiya", "hindustan")
QUALITY_TERMS = (
    "agriculture", "farming", "crop", "soil", "irrigation", "fertilizer", "pest", "disease", "yield", "harvest", "cultivation", "organic",
    "sustainable", "precision", "technology", "research", "study",
)
QUALITY_PLACES = (
    "India", "Indian", "Punjab", "Maharashtra", "Tamil Nadu", "Karnataka", "Uttar Pradesh", "West Bengal", "Gujarat", "Rajasthan", "Kerala",
    "Andhra Pradesh", "ICAR", "IARI", "government", "ministry",
)
HIGH_CREDIT = ("icar.org.in", "iari.res.in", "icrisat.org", "agricoop.nic.in", "gov.in", "edu", "ac.in", "res.in")
MEDIUM_CREDIT = ("researchgate.net", "springer.com", "sciencedirect.com", "jstor.org", "ieee.org", "nature.com", "science.org")
GENRES = ("survey", "dataset", "pdf", "book", "report", "article", "news", "thesis", "manual", "policy")
DATA_TYPES = ("statistical", "qualitative", "mixed", "technical", "policy")
BOT_MARKS = ("captcha", "are you a robot", "verify you are human", "cloudflare", "security check", "access denied", "unusual traffic")
NAVIGATION_MARKS = (
    "copyright ©", "all rights reserved", "privacy policy", "terms of service", "cookie policy", "contact us", "follow us", "subscribe", "newsletter",
    "sign up",
)
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")
AGENTS = (
    ("crop_specialist", "crops, varieties, cultivation, planting, cereal, grain", "plant breeding, seed selection, crop rotation, growth stages"),
    ("soil_expert", "soil health, nutrients, fertilizers, amendments", "soil chemistry, pH, organic matter, erosion"),
    ("pest_manager", "pests, diseases, IPM, biological control, pathogen, infection",
     "insect control, fungal, bacterial, viral, rust, blight, mildew, resistance, treatment"),
    ("sustainability_advisor", "sustainable practices, organic farming, environment", "conservation, renewable energy, water management"),
)
COVERAGE_TERMS = ("agriculture", "farming", "crop", "soil", "irrigation", "cultivation", "harvest", "fertilizer", "seed", "plant")
REPUTATION = {
    "wikipedia.org": 0.9, "github.com": 0.8, "stackoverflow.com": 0.8, "docs.python.org": 0.9, "mozilla.org": 0.8, "w3.org": 0.9, "ietf.org": 0.9,
    "arxiv.org": 0.8, "nature.com": 0.9, "science.org": 0.9, "ieee.org": 0.8, "acm.org": 0.8,
}
SPECIAL_TERMS = {
    "soil and climate management": "soil climate weather irrigation", "plant varieties and breeding": "varieties cultivars seeds breeding genetics",
    "fertilizers and nutrition": "fertilizer nutrients NPK organic compost", "irrigation and water management": "irrigation water drip sprinkler scheduling",
}
SPECIAL_WORDS = {
    "Crop Science & Plant Breeding": ("varieties", "genetics", "breeding", "yield"), "Soil Science & Fertility Management": ("soil", "fertility", "nutrients", "organic matter"),
    "Water Resources & Irrigation": ("irrigation", "water", "efficiency", "conservation"), "Plant Protection & Pest Management": ("pest", "disease", "protection", "management"),
    "Agricultural Technology & Precision Farming": ("technology", "precision", "smart", "digital"), "Sustainable & Organic Farming": ("sustainable", "organic", "natural", "eco-friendly"),
    "Agricultural Economics & Policy": ("economics", "policy", "market", "finance"), "Climate Change & Adaptation": ("climate", "adaptation", "resilience", "weather"),
    "Horticulture & Plantation Crops": ("horticulture", "fruits", "vegetables", "plantation"), "Livestock & Animal Husbandry": ("livestock", "animal", "dairy", "cattle"),
    "Food Processing & Post-Harvest": ("processing", "storage", "post-harvest", "value-addition"), "Rural Development & Extension": ("extension", "training", "rural", "development"),
}

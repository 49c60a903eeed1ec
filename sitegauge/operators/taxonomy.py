"""Keyword taxonomy of the business classification.

Fixed values: (label, parent or allowed industries, keywords) in tie-breaking order.
"""

INDUSTRIES = (
    ("Healthcare", None, (
        "healthcare", "health care", "clinic", "hospital", "medical", "doctor", "physician", "patient", "dermatology",
        "dermatologist", "skin", "hair treatment", "laser treatment", "aesthetic", "cosmetic treatment", "dental",
        "diagnostic")),
    ("Financial Services", None, (
        "finance", "financial", "loan", "lending", "credit", "nbfc", "emi", "insurance", "investment", "banking",
        "wallet", "payment", "mortgage", "wealth")),
    ("Industrial Materials", None, (
        "industrial", "raw material", "polymer", "plastic", "resin", "chemical", "granules", "masterbatch",
        "manufacturing material", "supplier", "procurement", "sourcing")),
    ("Food and Grocery", None, (
        "food", "grocery", "groceries", "fresh produce", "vegetables", "fruits", "organic", "farm fresh", "dairy",
        "meat", "beverage")),
    ("Software", None, (
        "software", "saas", "cloud", "api", "automation", "workflow", "dashboard", "crm", "analytics", "platform",
        "developer", "enterprise software")),
    ("Education", None, (
        "education", "learning", "student", "course", "school", "college", "university", "coaching", "training",
        "edtech", "classroom")),
    ("Commerce", None, (
        "ecommerce", "e-commerce", "online shopping", "shop", "store", "retail", "cart", "product catalog",
        "marketplace", "seller")),
    ("Real Estate", None, (
        "real estate", "property", "apartment", "villa", "plot", "home buyer", "rental", "broker", "builder",
        "residential", "commercial property")),
    ("Travel and Hospitality", None, (
        "travel", "hotel", "flight", "tour", "holiday", "resort", "booking", "itinerary", "hospitality", "stay",
        "vacation")),
    ("Automotive", None, (
        "automotive", "vehicle", "car", "bike", "scooter", "ev", "dealer", "used car", "auto service", "spare parts")),
    ("Legal Services", None, (
        "legal", "lawyer", "advocate", "law firm", "attorney", "compliance", "contract", "trademark", "litigation")),
    ("Marketing Services", None, (
        "marketing agency", "advertising agency", "performance marketing", "digital marketing", "seo agency",
        "ppc agency", "social media agency", "media buying", "brand campaign")),
    ("Manufacturing", None, (
        "manufacturing", "factory", "machining", "fabrication", "production line", "oem", "industrial equipment",
        "components", "assembly")),
)

SUB_INDUSTRIES = (
    ("Aesthetic Dermatology", "Healthcare", (
        "aesthetic clinic", "skin clinic", "laser treatment", "laser hair removal", "hair treatment",
        "hair transplant", "cosmetic dermatology", "dermatology", "dermatologist", "skin treatment", "acne treatment",
        "anti aging", "anti ageing", "botox", "fillers", "trichology", "skin care")),
    ("Digital Healthcare", "Healthcare", (
        "telemedicine", "online doctor", "doctor appointment", "medicine delivery", "health app",
        "diagnostics booking", "patient records", "virtual consultation")),
    ("Personal Loans", "Financial Services", (
        "personal loan", "instant loan", "salary loan", "digital loan", "loan app", "credit line", "borrow money",
        "emi", "paperless loan", "instant approval")),
    ("Digital Insurance", "Financial Services", (
        "health insurance", "life insurance", "motor insurance", "insurance policy", "insurance quote",
        "claim settlement", "policy renewal", "premium")),
    ("Polymers and Plastic Raw Materials", "Industrial Materials", (
        "polymer", "plastic raw material", "plastic resin", "resin", "hdpe", "ldpe", "lldpe", "pp granules", "pvc",
        "pet resin", "masterbatch", "elastomer", "polycarbonate", "abs plastic", "commodity polymers")),
    ("Industrial Chemicals", "Industrial Materials", (
        "industrial chemical", "specialty chemical", "solvent", "additive", "chemical supplier", "bulk chemical",
        "chemical distributor")),
    ("Organic Grocery", "Food and Grocery", (
        "organic grocery", "organic food", "organic vegetables", "organic fruits", "chemical free", "farm fresh",
        "natural produce", "fresh groceries")),
    ("Dairy and Fresh Foods", "Food and Grocery", (
        "milk", "dairy", "curd", "paneer", "fresh food", "farm milk", "eggs", "meat delivery")),
    ("SaaS", "Software", (
        "saas", "software as a service", "cloud software", "crm", "hrms", "billing software", "workflow automation",
        "analytics dashboard", "subscription software")),
    ("Developer Tools", "Software", (
        "api", "sdk", "developer platform", "documentation", "integration", "webhook", "database", "deployment",
        "monitoring")),
    ("Online Education", "Education", (
        "online learning", "online course", "live class", "test prep", "coaching", "upskilling", "certification",
        "learning app")),
    ("Ecommerce", "Commerce", (
        "ecommerce", "online store", "online shopping", "product catalog", "checkout", "cart", "delivery",
        "seller marketplace")),
    ("Property Search", "Real Estate", (
        "property search", "buy property", "rent property", "apartment", "villa", "plot", "real estate listing",
        "broker")),
    ("Travel Booking", "Travel and Hospitality", (
        "flight booking", "hotel booking", "holiday packages", "travel booking", "tour package", "itinerary",
        "resort booking")),
    ("Vehicle Marketplace", "Automotive", (
        "used car", "new car", "vehicle listing", "car dealer", "bike dealer", "electric scooter",
        "auto marketplace")),
    ("Online Legal Services", "Legal Services", (
        "legal advice", "online lawyer", "company registration", "trademark", "legal documents", "contract review",
        "compliance filing")),
    ("Digital Marketing", "Marketing Services", (
        "digital marketing", "seo", "performance marketing", "social media marketing", "ppc", "content marketing",
        "media buying", "influencer marketing")),
    ("Industrial Component Manufacturing", "Manufacturing", (
        "component manufacturing", "precision machining", "fabrication", "casting", "forging", "cnc", "assembly",
        "oem manufacturing")),
)

BUSINESS_MODELS = (
    ("Multi-Specialty Skin Clinic", ("Healthcare",), (
        "clinic", "skin clinic", "hair clinic", "aesthetic clinic", "multi specialty", "multi-specialty", "treatment",
        "consultation", "dermatologist", "laser")),
    ("Healthcare Platform", ("Healthcare",), (
        "platform", "app", "online consultation", "booking", "medicine delivery", "diagnostics", "patient portal")),
    ("Digital Lending Platform", ("Financial Services",), (
        "loan app", "digital lending", "online loan", "instant approval", "paperless", "credit line",
        "emi calculator", "apply online")),
    ("Insurance Marketplace", ("Financial Services",), (
        "compare insurance", "insurance marketplace", "quote", "buy policy", "renew policy", "claim support")),
    ("B2B Marketplace", ("Industrial Materials", "Manufacturing"), (
        "b2b", "marketplace", "supplier", "suppliers", "buyer", "buyers", "sourcing", "procurement", "rfq", "quote",
        "trade", "distributor")),
    ("D2C Delivery", ("Food and Grocery", "Commerce"), (
        "delivery", "home delivery", "subscription", "direct to consumer", "d2c", "order online",
        "same day delivery")),
    ("Online Marketplace", ("Commerce", "Automotive", "Real Estate"), (
        "marketplace", "seller", "listing", "catalog", "checkout", "buy", "sell", "cart", "vendor")),
    ("Subscription Software", ("Software",), (
        "subscription", "saas", "cloud platform", "enterprise", "self serve", "dashboard", "workflow",
        "integrations")),
    ("EdTech Platform", ("Education",), (
        "edtech", "learning platform", "live classes", "course platform", "subscription", "students", "teachers")),
    ("Online Travel Agency", ("Travel and Hospitality",), (
        "booking", "ota", "online travel", "deals", "packages", "reservation", "itinerary")),
    ("Agency Services", ("Marketing Services",), (
        "agency", "services", "consulting", "campaigns", "retainer", "creative", "media planning")),
    ("Service Provider", (), (
        "services", "consultation", "provider", "support", "solutions", "book appointment", "contact us")),
)

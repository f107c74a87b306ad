"""Rule tables: ordered (label, needles, attributes) lists.

Rule tables are *inputs*: every classifier takes a table argument and these
lists are only the defaults.  Order is meaningful (first match wins, ties go to
the earlier rule).  Small tables (a few hundred needles) are applied as literal
``contains`` chains, so no join or shuffle happens.
"""

from __future__ import annotations

# =============================================================================
# Fixed values.  These word lists, colours and sender addresses must equal the
# reference's for equal results; they are stated plainly and in their natural
# order.
# =============================================================================

# Words that mark a message as a subscription charge (any one suffices).
SUBSCRIPTION_INDICATORS = [
    "netflix", "prime video", "disney", "hotstar", "zee5", "youtube", "spotify", "apple music",
    "adobe", "microsoft", "google workspace", "zoom", "slack", "notion", "dropbox",
    "aws", "azure", "google cloud", "digitalocean",
    "subscription", "monthly", "yearly", "recurring", "auto-renewal",
]

# Trial vocabularies: model-output path, rules path, recurrence path.
TRIAL_WORDS_MODEL = ["trial", "free", "test", "demo", "preview", "beta"]
TRIAL_WORDS_RULES = ["trial", "free", "test", "demo", "preview", "beta", "promo"]
TRIAL_WORDS_RECUR = ["trial", "free", "test", "demo", "preview", "beta", "promo", "starter"]

# Subscription type ladder (first rung with a contained word wins) and icon.
SUBSCRIPTION_TYPES = [
    ("streaming", ["stream", "video", "movie", "tv"], "🎬"),
    ("music", ["music", "audio", "song"], "🎧"),
    ("saas", ["cloud", "storage", "software", "saas"], "☁️"),
    ("food_delivery", ["food", "delivery", "restaurant"], "🍕"),
    ("telecom", ["mobile", "internet", "phone"], "📱"),
]
SUBSCRIPTION_TYPE_OTHER = ("other", "🔄")
DEFAULT_ICON = "💳"

# Stated billing cycle ladder; no word -> monthly.
CYCLE_WORDS = [
    ("monthly", ["monthly", "month"]),
    ("quarterly", ["quarterly", "quarter"]),
    ("yearly", ["yearly", "annual", "year"]),
]
CYCLE_DEFAULT = "monthly"

# Category rules: score = number of listed keywords contained in the text.
CATEGORY_RULES = [
    ("food delivery", ["zomato", "swiggy", "uber eats", "foodpanda", "delivery", "dominos", "pizza", "kfc", "mcdonalds"], "#FF6B35"),
    ("restaurants", ["restaurant", "dining", "cafe", "coffee", "starbucks", "ccd", "bistro"], "#F7931E"),
    ("grocery stores", ["grocery", "supermarket", "big bazaar", "dmart", "reliance fresh", "more", "store"], "#4CAF50"),
    ("ride sharing", ["uber", "ola", "taxi", "cab", "ride"], "#000000"),
    ("fuel & petrol", ["petrol", "diesel", "fuel", "gas", "hp", "bharat petroleum", "iocl"], "#FF4444"),
    ("online shopping", ["amazon", "flipkart", "myntra", "jabong", "snapdeal", "online", "ecommerce"], "#FF5722"),
    ("streaming services", ["netflix", "prime video", "hotstar", "disney", "youtube", "spotify"], "#E50914"),
    ("saas services", ["google cloud", "aws", "azure", "office 365", "adobe", "dropbox"], "#4285F4"),
    ("pharmacy", ["pharmacy", "medical", "medicine", "drug", "apollo", "netmeds"], "#4CAF50"),
    ("atm withdrawal", ["atm", "withdrawal", "cash", "withdraw"], "#795548"),
    ("money transfer", ["transfer", "upi", "neft", "rtgs", "imps", "paytm", "phonepe", "gpay"], "#2196F3"),
    ("electricity bill", ["electricity", "power", "current bill", "bescom", "kseb"], "#FFC107"),
    ("internet & telecom", ["internet", "broadband", "wifi", "airtel", "jio", "bsnl", "mobile bill"], "#9C27B0"),
]
CATEGORY_NONE = "other transactions"

# Category from vendor words, used only when no category keyword matched.
VENDOR_CATEGORY_RULES = [
    ("restaurants", ["restaurant", "cafe", "kitchen", "food"], "#F7931E"),
    ("retail stores", ["store", "mart", "shop", "retail"], "#FF5722"),
    ("saas services", ["tech", "digital", "software", "app", "cloud"], "#4285F4"),
]

# Vendor candidates rejected when equal (lower case) to one of these.
VENDOR_STOPWORDS = ["the", "and", "for", "with", "from", "account", "bank", "card"]
UNKNOWN_VENDOR = "Unknown Vendor"

# Colour palette for categories without a preset, and the presets.
PALETTE = [
    "#E50914", "#4285F4", "#FF6B35", "#4CAF50", "#9C27B0", "#FF5722",
    "#00BCD4", "#FFC107", "#795548", "#607D8B", "#3F51B5", "#009688",
    "#8BC34A", "#CDDC39", "#FFEB3B", "#FF9800", "#FF5252", "#536DFE",
    "#1DB954", "#00A3E0", "#F7931E", "#FF4444", "#6C5CE7", "#74B9FF",
    "#A29BFE", "#FD79A8", "#FDCB6E", "#6C757D", "#E17055", "#2D3436",
]
PRESET_COLORS = [
    ("netflix", "#E50914"), ("youtube", "#FF0000"), ("spotify", "#1DB954"),
    ("google cloud", "#4285F4"), ("microsoft", "#0078D4"), ("adobe", "#FF0000"),
    ("amazon", "#FF9900"), ("uber", "#000000"), ("zomato", "#E23744"), ("swiggy", "#FC8019"),
    ("food delivery", "#FF6B35"), ("streaming services", "#E50914"), ("saas services", "#4285F4"),
    ("cloud platform", "#4285F4"), ("video streaming", "#E50914"), ("music streaming", "#1DB954"),
]
DEFAULT_COLOR = "#6C757D"

# Banks in list order with their alert sender addresses.
BANK_SENDERS = [
    ("SBI", ["donotreply.sbiatm@alerts.sbi.co.in", "alerts@sbi.co.in", "sbicard.alerts@sbi.co.in"]),
    ("HDFC Bank", ["alerts@hdfcbank.net", "hdfcbank@hdfcbank.net"]),
    ("ICICI Bank", ["alert@icicibank.com", "credit_cards@icicibank.com"]),
    ("Axis Bank", ["alerts@axisbank.com"]),
    ("Kotak Mahindra Bank", ["creditcardalerts@kotak.com"]),
    ("IDFC FIRST Bank", ["noreply@idfcfirstbank.com"]),
    ("Yes Bank", ["alerts@yesbank.in"]),
    ("IndusInd Bank", ["transactionalert@indusind.com"]),
    ("Chase", ["noreply@chase.com"]),
    ("Bank of America", ["alerts@bankofamerica.com"]),
    ("Citi Bank", ["alerts@citibank.com"]),
    ("Wells Fargo", ["alerts@wellsfargo.com"]),
    ("Capital One", ["notifications@capitalone.com"]),
    ("American Express", ["DoNotReply@americanexpress.com"]),
    ("Discover", ["donotreply@discover.com"]),
    ("Synchrony Bank", ["alerts@synchronybank.com"]),
    ("US Bank", ["customerservice@usbank.com"]),
    ("PNC Bank", ["alerts@pnc.com"]),
    ("Truist", ["no-reply@truist.com"]),
    ("Ally Bank", ["no-reply@ally.com"]),
    ("SoFi", ["support@sofi.com"]),
    ("PayPal", ["no-reply@paypal.com"]),
    ("Venmo", ["donotreply@venmo.com"]),
    ("TD Bank", ["mailer@tdbank.com", "alerts@td.com"]),
    ("Charles Schwab", ["no-reply@schwab.com"]),
]
# Fallback tokens when no address matched (in order).
BANK_TOKENS = [
    ("SBI", ["sbi", "statebank"]),
    ("HDFC Bank", ["hdfc"]),
    ("ICICI Bank", ["icici"]),
    ("Axis Bank", ["axis"]),
    ("Kotak Bank", ["kotak"]),
]
UNKNOWN_BANK = "Unknown Bank"
# Labels that name the same bank (the token rule spells one bank differently).
CANONICAL_BANK = {"Kotak Bank": "Kotak Mahindra Bank"}

# Mail search: subject and body terms tried after the sender addresses.
SEARCH_SUBJECT_TERMS = ["transaction", "debit", "credit", "withdrawal", "payment", "alert", "statement",
                        "google cloud"]
SEARCH_BODY_TERMS = ["google cloud"]

# Known services for pattern-detected subscriptions (needle, name, category, icon, colour, confidence).
SERVICE_RULES = [
    ("netflix", "Netflix", "Video Streaming", "🎬", "#E50914", 85),
    ("spotify", "Spotify", "Music Streaming", "🎧", "#1DB954", 85),
    ("youtube", "YouTube Premium", "Video Streaming", "▶️", "#FF0000", 80),
    ("amazon", "Amazon Prime", "Video Streaming", "📦", "#FF9900", 85),
    ("microsoft", "Microsoft 365", "Productivity SaaS", "💼", "#0078D4", 80),
    ("adobe", "Adobe Creative", "Design SaaS", "🎨", "#FF0000", 80),
    ("google cloud", "Google Cloud", "Cloud Platform", "☁️", "#4285F4", 90),
    ("google", "Google Workspace", "Productivity SaaS", "☁️", "#4285F4", 75),
]
CLOUD_WORDS = ["cloud", "aws", "azure", "gcp"]
CLOUD_SERVICE = ("Cloud Services", "☁️", "#4285F4", 75)
OTHER_SERVICE = ("Other Services", "💳", "#6C757D", 35)
UNKNOWN_SERVICE = "Unknown Service"
# Cloud vendor names that force the cloud_platform type in trial detection.
CLOUD_PLATFORM_NEEDLES = ["google cloud", "gcp"]
CLOUD_TRIAL_REASON = "Google Cloud trial/credits"

# Manual-subscription enrichment (needle, category, icon, colour), then word rungs.
ENRICH_RULES = [
    ("netflix", "Video Streaming", "🎬", "#E50914"),
    ("amazon prime", "Video Streaming", "📺", "#FF9900"),
    ("disney", "Video Streaming", "🏰", "#113CCF"),
    ("youtube", "Video Streaming", "▶️", "#FF0000"),
    ("spotify", "Music Streaming", "🎧", "#1DB954"),
    ("apple music", "Music Streaming", "🎵", "#FA243C"),
    ("hotstar", "Video Streaming", "🌟", "#0F1419"),
    ("microsoft", "Productivity SaaS", "💼", "#0078D4"),
    ("adobe", "Design SaaS", "🎨", "#FF0000"),
    ("google cloud", "Cloud Platform", "☁️", "#4285F4"),
    ("google", "Productivity SaaS", "☁️", "#4285F4"),
    ("dropbox", "Cloud Storage", "📦", "#0061FF"),
    ("zoom", "Video Conferencing", "📹", "#2D8CFF"),
    ("slack", "Team Communication", "💬", "#4A154B"),
    ("notion", "Productivity SaaS", "📝", "#000000"),
    ("zomato", "Food Delivery", "🍕", "#E23744"),
    ("swiggy", "Food Delivery", "🛵", "#FC8019"),
    ("uber eats", "Food Delivery", "🍔", "#000000"),
    ("airtel", "Telecom", "📶", "#E50000"),
    ("jio", "Telecom", "📱", "#0066CC"),
    ("vi", "Telecom", "📞", "#FF6B00"),
]
ENRICH_WORD_RULES = [
    (["stream", "video", "movie", "tv", "watch"], "Video Streaming", "🎬", "#E50914"),
    (["music", "audio", "song", "podcast"], "Music Streaming", "🎧", "#1DB954"),
    (["cloud", "storage", "backup", "sync"], "Cloud Services", "☁️", "#4285F4"),
    (["food", "restaurant", "delivery", "eat"], "Food Services", "🍕", "#FC8019"),
    (["mobile", "internet", "phone", "data"], "Telecom Services", "📱", "#E50000"),
    (["software", "saas", "tool", "app"], "Software SaaS", "⚙️", "#6C5CE7"),
]
ENRICH_OTHER = ("Other Services", "💳", "#6C757D")

# Model-output defaults when a key is absent.
MODEL_DEFAULT_CATEGORY = "Other Transactions"
MODEL_DEFAULT_CONFIDENCE = 50
# No-model mode: fixed analysis.
NONE_CATEGORY = "Other"
NONE_COLOR = "#6C757D"

# Billing-cycle arithmetic.
CYCLE_MONTH_DIVISOR = {"Quarterly": 3, "Yearly": 12}
CYCLE_YEAR_FACTOR = {"Monthly": 12, "Quarterly": 4, "Yearly": 1}
CYCLE_DAYS = {"Monthly": 30, "Quarterly": 90, "Yearly": 365}
CYCLE_BANDS = [("monthly", 25, 35), ("quarterly", 85, 95), ("yearly", 360, 370)]
DUE_SOON_DAYS = 7

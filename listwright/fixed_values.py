"""Fixed values.

Word lists, patterns, thresholds and formats the results depend on. They are plain
data: change them and the output changes.
"""

# --- fixed values: street words -------------------------------------------------
STREET_ABBREVIATIONS = {
    "boul": "boulevard",
    "blvd": "boulevard",
    "bd": "boulevard",
    "ch": "chemin",
    "av": "avenue",
    "o": "ouest",
    "e": "est",
    "n": "nord",
    "s": "sud",
}
STREET_TYPES = {
    "rue": "street",
    "avenue": "avenue",
    "boulevard": "boulevard",
    "chemin": "road",
}
STREET_DIRECTIONS = {
    "ouest": "west",
    "nord": "north",
    "sud": "south",
    "est": "east",
}

# --- fixed values: names and sites ----------------------------------------------
SKIP_WORDS = ["au", "le", "de", "the"]
SITES = ["facebook", "yelp", "yellowpages", "urbanspoon", "twitter"]
CITY = "montreal"

# Hosts that are never a listing's own website (compared label by label).
HOST_DENYLIST = [
    "restomontreal",
    "googleusercontent",
    "webcache",
    "google",
    "facebook",
    "yelp",
    "yellowpages",
    "urbanspoon",
    "twitter",
    "foursquare",
    "zagat",
    "blogspot",
    "tripadvisor",
    "pagesjaunes",
    "montrealplus",
    "canpages",
    "blackbookmag",
    "adbeux",
    "about",
    "citeeze",
    "nightlife",
    "restaurant",
    "canplaces",
    "yahoo",
    "profilecanada",
    "mtlblog",
    "nearyou",
    "foodpages",
]

# --- fixed values: thresholds ---------------------------------------------------
ACCEPT_ABOVE = 0.75
REVIEW_BELOW = 0.8

# --- fixed values: patterns -----------------------------------------------------
# A text node that is nothing but a phone number; area code and exchange start with 2-9.
PHONE_NODE = r"^(?:\([2-9]\d{2}\)\ ?|[2-9]\d{2}(?:\-?|\ ?))[2-9]\d{2}[- ]?\d{4}$"
# Anything phone-like; "[ -\.]" is the range from space to full stop.
PHONE_LOOSE = r"[(]{0,1}\d{3}[) \.]{0,2}\d{3}[ -\.]{0,1}\d{4}"
# Every phone of a page.
PHONE_ANY = r"[\( ]?\d{3}[\)]?[ \.]?\d{3}[-\. ]\d{4}"
HOUSE_NUMBER = r"^(\d{1,5}[A-Z](?=[ ,])|\d{1,5})"
ADDRESS_IN_TEXT = r"\d{1,5}[ ][\w -\.,]*[mM]ontr[eé]al[\w -\.,]*"
ADDRESS_IN_TEXT_NARROW = r"\d{1,5}[ ][A-Za-z -\.,]*[mM]ontr[eé]al[\w -\.,]{2,15}"
MAP_MARKER = "/mapfiles/marker-noalpha.png"

# --- fixed values: lookups (prefix, space, city part, lower-cased) --------------
LOOKUPS = {
    "search": ("https://www.google.ca/search?q=", "+", "+{city}", True),
    "review": ("https://www.yelp.com/search?find_desc=", "+", "&find_loc={city}", True),
    "profile": ("https://twitter.com/search?q=", "%20", "%20{city}&mode=users", False),
}
REVIEW_HOST = "https://www.yelp.com"
PROFILE_HOST = "twitter.com"

# --- fixed values: report format ------------------------------------------------
PRINTED_ATTRIBUTES = ["address", "phone", "website", "facebook", "twitter"]
RTF_HEADER = (
    "{\\rtf1\\ansi\\ansicpg1252\\deff0\\deflang1033"
    "{\\fonttbl{\\f0\\fnil\\fcharset0 Helvetica;}}\n"
    "{\\colortbl ;\\red0\\green0\\blue255;}\n"
    "{\\*\\generator Msftedit 5.41.21.2509;}"
    "\\viewkind4\\uc1\\pard\\sa200\\sl276\\slmult1\\lang9\\f0\\fs22\n\n"
)
RTF_CLOSE = "}"
RTF_LINE = " \\line\n"
RTF_BLOCK_END = "\\line\n\n"
REPORT_SUFFIX = "_HYPERLINKED.rtf"
PROFILE_LIST_SUFFIX = "_TWITTERS.txt"

"""Token rewrites and stop words that results depend on."""

LEGAL = {"corp": "corporation", "inc": "incorporated", "ltd": "limited", "llc": "limited", "pvt": "private", "co": "company", "llp": "limited"}
LEGAL_V1 = {k: v for k, v in LEGAL.items() if k != "llp"}
STREET = {"rd": "road", "st": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "ln": "lane", "dr": "drive"}
SUFFIX_A = LEGAL | {"incorp": "incorporated", "plc": "public"}
ADDRESS_A = STREET | {
    "hwy": "highway", "pkwy": "parkway", "ste": "suite", "apt": "apartment", "bldg": "building", "fl": "floor", "n": "north", "s": "south",
    "e": "east", "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest",
}
LEGAL_B = LEGAL_V1 | {"plc": "public"}
STREET_B = STREET | {"hwy": "highway", "ste": "suite", "apt": "apartment"}
DOMAINS = ("com", "net", "org", "io", "co", "in", "fr", "us")
STOP = ("the", "and", "of", "a", "an", "for", "to", "in", "on", "at", "by")
LEGAL_STOP = (
    "private", "limited", "corporation", "incorporated", "company", "companies", "group", "holdings", "services", "service", "solutions",
    "international", "india", "llc", "ltd", "inc", "corp", "pvt",
)
ADDR_STOP = (
    "road", "street", "avenue", "lane", "drive", "boulevard", "floor", "near", "opposite", "opp", "building", "block", "sector", "house",
    "office", "shop", "plot", "door", "main", "cross", "suite", "unit", "apartment", "nagar", "colony", "village", "district", "state",
    "city", "west", "east", "north", "south", "india", "united", "states", "america", "france", "complex", "tower", "phase", "stage",
    "ground", "first", "second", "third", "limited", "private", "company", "post", "area", "industrial", "estate", "park", "rue",
)

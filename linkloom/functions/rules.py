"""Word lists of the cleaning rules."""

from __future__ import annotations

# Spelling of a legal word -> its short form.
LEGAL_WORDS = {
    "inc": "inc", "incorporated": "inc", "llc": "llc", "llp": "llp", "lp": "lp", "pllc": "pllc", "pc": "pc", "plc": "plc",
    "corp": "corp", "corporation": "corp", "co": "co", "company": "co", "ltd": "ltd", "limited": "ltd",
    "pvt": "pvt", "private": "pvt", "praivet": "pvt", "praibhet": "pvt", "piraivet": "pvt", "praivatt": "pvt",
    "limitet": "ltd", "limittad": "ltd", "limtid": "ltd", "elelpi": "llp", "elaelpi": "llp",
    "sarl": "sarl", "sas": "sas", "sasu": "sasu", "eurl": "eurl", "sa": "sa", "sci": "sci", "snc": "snc", "gmbh": "gmbh",
}

# Spelled-out letters -> the abbreviation.
LETTER_SEQUENCES = {"l l c": "llc", "l l p": "llp", "p l c": "plc", "pra li": "pvt ltd"}

# Short form in an address -> long form.
ADDRESS_WORDS = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "dr": "drive", "ln": "lane", "ct": "court",
    "blvd": "boulevard", "bd": "boulevard", "bld": "boulevard", "pl": "place", "hwy": "highway", "pkwy": "parkway",
    "cir": "circle", "ter": "terrace", "trl": "trail", "sq": "square", "apt": "apartment", "apts": "apartments",
    "ste": "suite", "fl": "floor", "flr": "floor", "bldg": "building", "opp": "opposite", "nr": "near", "mkt": "market",
    "ngr": "nagar", "r": "rue", "imp": "impasse", "ch": "chemin", "mt": "mount", "ft": "fort",
    "n": "north", "s": "south", "e": "east", "w": "west",
}

# Words of an address that say nothing.
ADDRESS_FILLER_WORDS = ["null", "none", "nan", "no", "number", "h", "hno"]

# State or region -> code.
STATE_NAMES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
    "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id",
    "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me",
    "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo",
    "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm",
    "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or",
    "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn",
    "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv",
    "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc",
    "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "goa": "ga",
    "gujarat": "gj", "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "krnatk": "ka",
    "kerala": "kl", "madhya pradesh": "mp", "maharashtra": "mh", "mharastr": "mh", "manipur": "mn", "meghalaya": "ml",
    "mizoram": "mz", "nagaland": "nl", "odisha": "od", "orissa": "od", "punjab": "pb", "rajasthan": "rj", "sikkim": "sk",
    "tamil nadu": "tn", "telangana": "ts", "tripura": "tr", "uttar pradesh": "up", "uttarakhand": "uk",
    "west bengal": "wb", "delhi": "dl", "dilli": "dl", "chandigarh": "ch", "puducherry": "py", "jammu and kashmir": "jk",
    "ladakh": "la", "maharashtr": "mh", "karnatak": "ka", "tamizhnatu": "tn", "tamilnatu": "tn", "gujrat": "gj",
    "pashchimbang": "wb", "pashchim bang": "wb", "telangan": "ts", "hariyana": "hr", "kerlan": "kl", "keral": "kl",
    "madhy pradesh": "mp", "andhrapradesh": "ap", "andhr pradesh": "ap", "panjab": "pb", "orisha": "od",
    "uttrakhand": "uk", "gova": "ga",
}

# Letters that sound alike, replaced in this order.
SOUND_PAIRS = [
    ("chh", "C"), ("ch", "C"), ("sh", "s"), ("ph", "f"), ("kh", "k"), ("gh", "k"), ("th", "t"), ("dh", "t"), ("bh", "p"),
    ("jh", "C"), ("ck", "k"), ("q", "k"), ("x", "ks"), ("w", "v"), ("z", "C"), ("j", "C"), ("b", "p"), ("d", "t"),
    ("g", "k"), ("c", "k"),
]

# Digits written for letters, and the letters.
DIGITS_FOR_LETTERS = ("0134568", "oleasgb")

# Words that a rival's name key leaves out.
RIVAL_STOP_WORDS = [
    "llc", "inc", "ltd", "limited", "pvt", "private", "corp", "corporation", "co", "company", "the", "lp", "llp", "pc", "pa",
    "plc", "pllc", "sarl", "sas", "sasu", "eurl", "sa", "sci", "and", "of",
]

# Patterns.
WEBSITE = r"(https?://)?(www\.)?([a-z0-9-]+)\.(com|net|org|in|co|biz|info|fr|us|io)(\.[a-z]{2})?\b"
DOT_IN_INITIALS = r"(?<=\b[a-z])\.(?=[a-z]\b)"

LEGAL_FORMS = sorted(set(LEGAL_WORDS.values()))
LONG_LEGAL_WORDS = [w for w in LEGAL_WORDS if len(w) >= 5]

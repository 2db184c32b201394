"""Word lists, lookup tables and patterns that results depend on, as plain text."""

from __future__ import annotations

import unicodedata

# ---- fixed values -------------------------------------------------------------------------------------------------
# fmt: off
#: Legal forms in company names; one form stands for two tokens.
LEGAL = {
    "private": "private", "pvt": "private", "pte": "private", "prvt": "private", "pvtltd": "private limited",
    "limited": "limited", "ltd": "limited", "ltda": "limited", "ld": "limited", "incorporated": "inc", "inc": "inc",
    "incorporation": "inc", "corporation": "corp", "corp": "corp", "corpn": "corp", "company": "co", "co": "co",
    "coy": "co", "cie": "co", "compagnie": "co", "llc": "llc", "llp": "llp", "lp": "lp", "plc": "plc", "pllc": "pllc",
    "pc": "pc", "pa": "pa", "sa": "sa", "sarl": "sarl", "sas": "sas", "sasu": "sasu", "eurl": "eurl", "snc": "snc",
    "sci": "sci", "selarl": "selarl", "gmbh": "gmbh", "ag": "ag", "bv": "bv", "nv": "nv", "opc": "opc",
    "public": "public",
}
#: Dotted or spaced legal forms, joined before a name is split, in this order.
LEGAL_JOINS = [
    (r"\bl\s*\.?\s*l\s*\.?\s*c\b\.?", " llc "),
    (r"\bl\s*\.?\s*l\s*\.?\s*p\b\.?", " llp "),
    (r"\bp\s*\.?\s*l\s*\.?\s*l\s*\.?\s*c\b\.?", " pllc "),
    (r"\bp\s*\.\s*c\b\.?", " pc "),
    (r"\bp\s*\.\s*a\b\.?", " pa "),
    (r"\bl\s*\.\s*p\b\.?", " lp "),
    (r"\bs\s*\.\s*a\s*\.\s*r\s*\.\s*l\b\.?", " sarl "),
    (r"\bs\s*\.\s*a\s*\.\s*s\b\.?", " sas "),
    (r"\be\s*\.\s*u\s*\.\s*r\s*\.\s*l\b\.?", " eurl "),
    (r"\bs\s*\.\s*a\b\.?", " sa "),
    (r"\bs\s*\.\s*n\s*\.\s*c\b\.?", " snc "),
    (r"\bs\s*\.\s*c\s*\.\s*i\b\.?", " sci "),
    (r"\bpvt\s*\.?\s*ltd\b", " private limited "),
    (r"\bpvt\.", " pvt "),
]
#: Legal forms that name a category of their own, by priority.
LEGAL_PRIORITY = [
    "llp", "llc", "pllc", "plc", "lp", "pc", "pa", "sarl", "sas", "sasu", "eurl", "snc", "sci", "sa", "gmbh",
]
#: Then the category that has one of these tokens; private and limited together are pvtltd.
LEGAL_CATEGORIES = {"inc": {"inc", "corp"}, "ltd": {"limited"}, "co": {"co"}, "pvt": {"private"}}
NAME_PREFIXES = [
    "the", "dr", "sri", "shri", "shree", "sree", "mr", "mrs", "ms", "smt", "messrs", "a", "an", "le", "la", "les", "l",
]
NAME_STOP = [
    "the", "and", "of", "de", "du", "des", "la", "le", "les", "l", "d", "a", "an", "et",
]
#: Abbreviations in company names.
NAME_ABBREVIATIONS = {
    "intl": "international", "natl": "national", "mfg": "manufacturing", "svc": "services", "svcs": "services",
    "tech": "technologies", "technology": "technologies", "assoc": "associates", "bros": "brothers",
    "engg": "engineering", "grp": "group", "hosp": "hospital", "inds": "industries", "ind": "industries",
    "industry": "industries", "mgmt": "management", "mktg": "marketing", "pharma": "pharmaceuticals", "sys": "systems",
    "univ": "university", "ent": "enterprises", "ents": "enterprises", "enterprise": "enterprises",
    "hldgs": "holdings", "ctr": "center", "centre": "center", "cntr": "center", "n": "and", "et": "and",
    "ets": "etablissements", "ste": "societe", "st": "saint", "mt": "mount", "service": "services",
    "solution": "solutions", "consultant": "consultants", "holding": "holdings", "partner": "partners",
    "product": "products", "system": "systems", "brother": "brothers", "export": "exports", "venture": "ventures",
    "infratech": "infratech",
}
#: Abbreviations in addresses; an empty value drops the word.
ADDRESS_ABBREVIATIONS = {
    "street": "st", "str": "st", "st": "st", "saint": "st", "ste": "ste", "sreet": "st", "stree": "st", "road": "rd",
    "rd": "rd", "raod": "rd", "avenue": "av", "ave": "av", "av": "av", "avn": "av", "avenu": "av", "boulevard": "bd",
    "blvd": "bd", "bd": "bd", "boul": "bd", "bld": "bd", "lane": "ln", "ln": "ln", "drive": "dr", "dr": "dr",
    "drv": "dr", "court": "ct", "ct": "ct", "crt": "ct", "place": "pl", "pl": "pl", "plaza": "plz", "plz": "plz",
    "square": "sq", "sq": "sq", "terrace": "ter", "ter": "ter", "terr": "ter", "circle": "cir", "cir": "cir",
    "highway": "hwy", "hwy": "hwy", "parkway": "pkwy", "pkwy": "pkwy", "pky": "pkwy", "expressway": "expy",
    "expy": "expy", "freeway": "fwy", "trail": "trl", "trl": "trl", "route": "rte", "rte": "rte", "rt": "rte",
    "way": "way", "wy": "way", "suite": "ste", "apartment": "apt", "apt": "apt", "appt": "apt", "apts": "apt",
    "unit": "unit", "floor": "fl", "fl": "fl", "flr": "fl", "building": "bldg", "bldg": "bldg", "room": "rm",
    "rm": "rm", "mount": "mt", "mt": "mt", "fort": "ft", "ft": "ft", "point": "pt", "pt": "pt", "heights": "hts",
    "hts": "hts", "junction": "jct", "jct": "jct", "north": "n", "n": "n", "south": "s", "s": "s", "east": "e",
    "e": "e", "west": "w", "w": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw",
    "near": "nr", "nr": "nr", "opposite": "opp", "opp": "opp", "oppo": "opp", "behind": "bhd", "bhd": "bhd",
    "station": "stn", "stn": "stn", "sector": "sec", "sec": "sec", "sect": "sec", "phase": "ph", "ph": "ph",
    "block": "blk", "blk": "blk", "complex": "cmplx", "cmplx": "cmplx", "colony": "col", "col": "col", "nagar": "ngr",
    "ngr": "ngr", "extension": "extn", "extn": "extn", "ext": "extn", "society": "soc", "soc": "soc",
    "district": "dist", "dist": "dist", "distt": "dist", "village": "vill", "vill": "vill", "industrial": "indl",
    "indl": "indl", "estate": "est", "est": "est", "market": "mkt", "mkt": "mkt", "main": "main", "cross": "crs",
    "crs": "crs", "ground": "gr", "gf": "gr", "marg": "marg", "mg": "marg", "rue": "rue", "r": "rue", "allee": "all",
    "allees": "all", "all": "all", "impasse": "imp", "imp": "imp", "chemin": "ch", "che": "ch", "ch": "ch",
    "chem": "ch", "faubourg": "fbg", "fbg": "fbg", "quai": "qu", "cours": "crs", "chaussee": "chs", "city": "",
    "cdp": "", "township": "", "tonship": "", "twp": "", "of": "", "the": "", "no": "", "number": "", "num": "",
    "nbr": "", "null": "", "none": "", "nan": "", "house": "", "hno": "", "h": "", "door": "", "plot": "", "plno": "",
    "flno": "", "shop": "", "po": "", "box": "", "pin": "", "pincode": "", "code": "", "de": "", "du": "", "des": "",
    "la": "", "le": "", "les": "", "d": "", "l": "", "c": "", "o": "", "and": "", "county": "cnty", "cnty": "cnty",
    "ndeg": "", "bis": "",
}
#: Short forms with a slash in addresses, in this order.
ADDRESS_SLASHES = {"c/o": " co ", "b/h": " bhd ", "s/o": " so ", "w/o": " wo "}
#: Number words in addresses.
NUMBER_WORDS = {
    "first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6", "seventh": "7",
    "eighth": "8", "ninth": "9", "tenth": "10", "eleventh": "11", "twelfth": "12", "thirteenth": "13",
    "fourteenth": "14", "fifteenth": "15", "sixteenth": "16", "seventeenth": "17", "eighteenth": "18",
    "nineteenth": "19", "twentieth": "20", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9", "ten": "10", "premier": "1", "premiere": "1", "deuxieme": "2",
    "troisieme": "3",
}
#: Regions of several words.
REGIONS_OF_WORDS = {
    "new york": "ny", "new jersey": "nj", "new mexico": "nm", "new hampshire": "nh", "north carolina": "nc",
    "south carolina": "sc", "north dakota": "nd", "south dakota": "sd", "west virginia": "wv", "rhode island": "ri",
    "district of columbia": "dc", "tamil nadu": "tn", "uttar pradesh": "up", "madhya pradesh": "mp",
    "andhra pradesh": "ap", "himachal pradesh": "hp", "arunachal pradesh": "arp", "west bengal": "wb",
    "jammu and kashmir": "jk", "jammu kashmir": "jk", "new delhi": "newdelhi",
}
#: Regions and cities of one word.
REGIONS = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co_",
    "connecticut": "ct_", "delaware": "de_", "florida": "fl_", "georgia": "ga", "hawaii": "hi", "idaho": "id_",
    "illinois": "il", "indiana": "in_", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la_",
    "maine": "me_", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms",
    "missouri": "mo", "montana": "mt_", "nebraska": "ne_", "nevada": "nv", "ohio": "oh", "oklahoma": "ok",
    "oregon": "or_", "pennsylvania": "pa", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt",
    "virginia": "va", "washington": "wa", "wisconsin": "wi", "wyoming": "wy", "maharashtra": "mh", "karnataka": "ka",
    "gujarat": "gj", "rajasthan": "rj", "kerala": "kl", "haryana": "hr", "punjab": "pb", "bihar": "br", "odisha": "od",
    "orissa": "od", "jharkhand": "jh", "chhattisgarh": "cg", "uttarakhand": "uk", "telangana": "ts", "tg": "ts",
    "assam": "as_", "goa": "goa", "tripura": "tr_", "meghalaya": "ml_", "manipur": "mn_", "nagaland": "nl_",
    "mizoram": "mz", "sikkim": "sk", "chandigarh": "chd", "puducherry": "py", "pondicherry": "py", "bombay": "mumbai",
    "bangalore": "bengaluru", "bengalore": "bengaluru", "banglore": "bengaluru", "madras": "chennai",
    "calcutta": "kolkata", "gurgaon": "gurugram", "poona": "pune", "baroda": "vadodara",
    "trivandrum": "thiruvananthapuram", "cochin": "kochi", "mysore": "mysuru", "nyc": "ny", "delhi": "delhi",
    "dl": "delhi",
}
#: Address words too common to be blocking keys.
ADDRESS_GENERIC = [
    "st", "rd", "av", "bd", "ln", "dr", "ct", "pl", "plz", "sq", "ter", "cir", "hwy", "pkwy", "expy", "fwy", "trl",
    "rte", "way", "ste", "apt", "unit", "fl", "bldg", "rm", "n", "s", "e", "w", "ne", "nw", "se", "sw", "nr", "opp",
    "bhd", "sec", "blk", "col", "ngr", "extn", "soc", "dist", "vill", "indl", "est", "mkt", "main", "crs", "gr",
    "marg", "rue", "all", "imp", "ch", "cnty", "floor", "road",
]
#: Digits that stand for letters in misread words.
OCR_DIGITS, OCR_LETTERS = "0153487", "olseabt"
#: Sound-alike spellings, replaced in this order.
SKELETON_RULES = [("ph", "f"), ("sh", "s"), ("ch", "c"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("jh", "j"), ("ck", "k"),
    ("w", "v"), ("z", "j"), ("q", "k"), ("x", "ks"), ("y", "i"), ("c", "k"),
]
#: The m/s before a name, a website after a bar, a name that is a domain, and what stands between two names of one company.
MESSRS = r"^\s*m\s*/\s*s\b\.?"
WEBSITE = r"\|\s*(?:https?://)?(?:www\.)?([a-z0-9\-]+)(?:\.[a-z]{2,4}){1,2}\S*"
DOMAIN = r"^#?\s*(?:www\.)?([a-z0-9\-]+)((?:\.[a-z]{2,4}){1,2})?$"
OTHER_NAME = r"\b(?:trading as|doing business as|formerly known as|formerly|t\s*/\s*a|d\s*/\s*b\s*/\s*a|dba|f\s*/\s*k\s*/\s*a|fka|a\s*/\s*k\s*/\s*a|aka)\b\.?"
#: An l that is a misread i; numbers with a suffix, which are not misread words; ordinals; postal codes in two parts.
MISREAD_L = r"^l(?=[bcdfgkmnpqrstvwxz])"
SUFFIXED_NUMBER = r"^[0-9]+(st|nd|rd|th|er|e|eme|b|a|bis)$"
ORDINAL = r"^([0-9]+)(?:st|nd|rd|th|er|eme|e|re)$"
ZIP_PLUS_FOUR = r"\b([0-9]{5})-[0-9]{4}\b"
SPLIT_PIN = r"\b([0-9]{3})\s([0-9]{3})\b"
#: Brahmic scripts, and characters without width.
INDIC = "[\u0900-\u0dff]"
ZERO_WIDTH = "[\u200b-\u200d\ufeff]"
# fmt: on

# ---- tables made by rule ------------------------------------------------------------------------------------------
def _latin() -> tuple[str, str, list[tuple[str, str]]]:
    """Accented letters by their decomposition: single letters for translate(), and those that become several."""
    one, to, several = "", "", [("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("Þ", "Th")]
    rest = dict(zip("øØđĐłŁħĦðÐıŋŊ–—‘’‚“”„·", "oOdDlLhHdDinN--'''\"\"\"*", strict=True))
    for code in [*range(0xC0, 0x250), *map(ord, rest)]:
        c = chr(code)
        base = rest.get(c) or unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(base) == 1:
            one, to = one + c, to + base
        elif len(base) > 1 and all(c != x for x, _ in several):
            several.append((c, base))
    return one, to, several


def _indic_slots() -> list[str]:
    """Romanisation of the 128 places that the Brahmic blocks share, by the names of the Devanagari characters."""
    short = {"AA": "a", "II": "i", "UU": "u", "CANDRABINDU": "m", "ANUSVARA": "n", "VISARGA": "h", "CANDRA E": "e", "CANDRA O": "o", "SHORT E": "e", "SHORT O": "o", "VOCALIC R": "r", "VOCALIC L": "l"}
    slots = []
    for code in range(0x0900, 0x0980):
        name = unicodedata.name(chr(code), "")
        kind, _, rest = name.removeprefix("DEVANAGARI ").partition(" ")
        if kind == "DIGIT":
            slots.append(str(unicodedata.digit(chr(code))))
        elif kind == "SIGN" and rest in short:
            slots.append(short[rest])
        elif kind in ("LETTER", "VOWEL") and name:
            sound = rest.removeprefix("SIGN ")
            sound = short.get(sound, sound.lower())
            # Consonants are named with the vowel that they carry.
            slots.append(sound[:-1] if len(sound) > 1 and sound.endswith("a") and kind == "LETTER" and code >= 0x0915 else sound.split(" ")[0])
        else:
            slots.append("")
    return slots


#: Single letters and their plain ones, in the same order; letters that become several.
ACCENTED, PLAIN, SPELLED_OUT = _latin()
INDIC_SLOTS = _indic_slots()

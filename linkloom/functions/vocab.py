"""Fixed word lists of the two normalisers.

The values below are fixed: results depend on each of them. Two families exist side by side, ``A`` for the
retrieval line and ``B`` for the embedding line, and they differ on purpose.
"""

from __future__ import annotations

# --- fixed values, line A -------------------------------------------------------------------------
LEGAL_A = {
    "corporation": "corp", "corp": "corp", "incorporated": "inc", "inc": "inc", "limited": "ltd", "ltd": "ltd",
    "private": "pvt", "pvt": "pvt", "pvtltd": "pvt ltd", "company": "co", "co": "co", "llc": "llc", "llp": "llp",
    "lp": "lp", "pllc": "pllc", "pc": "pc", "plc": "plc", "public": "public", "sa": "sa", "sas": "sas",
    "sasu": "sasu", "sarl": "sarl", "sci": "sci", "eurl": "eurl", "snc": "snc", "gmbh": "gmbh", "opc": "opc",
    "lc": "lc", "ltda": "ltda", "pa": "pa", "pty": "pty",
}
NAME_STOP_A = ["the", "mr", "mrs", "ms", "smt", "m s", "messrs", "of", "and", "et", "le", "la", "les", "des", "du", "de"]
ADDR_ABBR_A = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard",
    "bd": "boulevard", "bvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "cir": "circle",
    "pl": "place", "pkwy": "parkway", "hwy": "highway", "sq": "square", "ter": "terrace", "trl": "trail",
    "cres": "crescent", "mt": "mount", "ft": "fort", "twp": "township", "hts": "heights", "pt": "point",
    "n": "north", "s": "south", "e": "east", "w": "west", "so": "south", "no": "no", "r": "rue", "ch": "chemin",
    "imp": "impasse", "fbg": "faubourg", "rte": "route", "all": "allee", "bldg": "building", "apts": "apartment",
    "appt": "apartment", "opp": "opposite", "nr": "near", "fl": "floor", "flr": "floor", "flt": "flat",
    "flta": "flat", "rly": "railway", "stn": "station", "extn": "extension", "ext": "extension", "sec": "sector",
    "mkt": "market", "cplx": "complex", "bombay": "mumbai", "gurgaon": "gurugram", "bangalore": "bengaluru",
    "calcutta": "kolkata", "madras": "chennai", "poona": "pune",
}
ADDR_STOP_A = [
    "no", "door", "dor", "doro", "h", "hno", "hn", "house", "number", "num", "null", "none", "na", "unit", "apt",
    "apartment", "suite", "ste", "floor", "flat", "the", "of", "near", "opposite", "de", "du", "la", "le", "des",
    "cdp", "city", "town", "village", "region", "dist", "district",
]
US_STATES_A = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado",
    "ct": "connecticut", "de": "delaware", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho",
    "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana",
    "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan", "mn": "minnesota",
    "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada",
    "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina",
    "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania",
    "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas",
    "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin",
    "wy": "wyoming", "dc": "district of columbia", "pr": "puerto rico",
}
IN_STATES_A = {
    "ap": "andhra pradesh", "ar": "arunachal pradesh", "as": "assam", "br": "bihar", "cg": "chhattisgarh",
    "ga": "goa", "gj": "gujarat", "hr": "haryana", "hp": "himachal pradesh", "jh": "jharkhand", "ka": "karnataka",
    "kl": "kerala", "mp": "madhya pradesh", "mh": "maharashtra", "mn": "manipur", "ml": "meghalaya",
    "mz": "mizoram", "nl": "nagaland", "od": "odisha", "or": "orissa", "pb": "punjab", "rj": "rajasthan",
    "sk": "sikkim", "tn": "tamil nadu", "tg": "telangana", "ts": "telangana", "tr": "tripura",
    "up": "uttar pradesh", "uk": "uttarakhand", "ut": "uttarakhand", "wb": "west bengal", "dl": "delhi",
    "jk": "jammu and kashmir", "ch": "chandigarh", "py": "puducherry", "la": "ladakh",
    "an": "andaman and nicobar islands", "dn": "dadra and nagar haveli", "ld": "lakshadweep",
}
MORE_STATES_A = ["uttaranchal", "orissa", "pondicherry", "nct of delhi"]
PHONETIC_PAIRS_A = [("ght", "t"), ("ph", "f"), ("sh", "s"), ("ch", "c"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("kh", "k"), ("gh", "g"), ("ck", "k"), ("wh", "v")]

# --- fixed values, line B -------------------------------------------------------------------------
LEGAL_WORDS_B = [
    "inc", "incorporated", "corp", "corporation", "co", "company", "llc", "llp", "lp", "ltd", "limited", "plc",
    "pc", "pllc", "pa", "the", "and", "of", "dba", "pvt", "private", "pvtltd", "opc", "sarl", "sas", "sasu", "sa",
    "eurl", "sci", "snc", "cie", "et", "de", "du", "des", "la", "le", "les",
]
LEGAL_FORMS_B = {
    "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "co": "co", "company": "co",
    "llc": "llc", "llp": "llp", "lp": "lp", "ltd": "ltd", "limited": "ltd", "plc": "plc", "pc": "pc",
    "pllc": "pllc", "pa": "pa", "pvt": "pvt", "private": "pvt", "opc": "opc", "sarl": "sarl", "sas": "sas",
    "sasu": "sasu", "sa": "sa", "eurl": "eurl", "sci": "sci", "snc": "snc", "cie": "co",
}
FILLER_B = [
    "group", "partners", "center", "centre", "holdings", "enterprises", "services", "solutions", "associates",
    "ventures", "international", "global", "www", "com",
]
ADDR_JUNK_B = ["city", "icty", "ctiy", "cdp", "county", "hq", "region"]
ADDR_ABBR_B = {
    "rd": "road", "st": "street", "str": "street", "ave": "avenue", "av": "avenue", "avn": "avenue", "dr": "drive",
    "ln": "lane", "blvd": "boulevard", "bd": "boulevard", "ct": "court", "pl": "place", "cir": "circle",
    "hwy": "highway", "pkwy": "parkway", "ste": "suite", "apt": "apartment", "fl": "floor", "flr": "floor",
    "bldg": "building", "nr": "near", "opp": "opposite", "sq": "square", "ter": "terrace", "trl": "trail",
    "pt": "point", "mt": "mount", "ft": "fort", "no": "no", "num": "no", "hno": "house no", "h": "house",
    "r": "rue", "ch": "chemin", "chem": "chemin", "imp": "impasse", "rte": "route", "fbg": "faubourg",
    "all": "allee", "pce": "place", "qu": "quai", "crs": "cours",
}
#: State names to codes, in the order in which overlapping names are tried.
STATES_B = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
    "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id",
    "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la",
    "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn",
    "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv",
    "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc",
    "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa",
    "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx",
    "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi",
    "wyoming": "wy", "district of columbia": "dc", "andhra pradesh": "ap", "arunachal pradesh": "ar",
    "assam": "as", "bihar": "br", "chhattisgarh": "cg", "goa": "ga", "gujarat": "gj", "haryana": "hr",
    "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl", "madhya pradesh": "mp",
    "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od",
    "orissa": "od", "punjab": "pb", "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn", "telangana": "tg",
    "tripura": "tr", "uttar pradesh": "up", "uttarakhand": "uk", "west bengal": "wb", "delhi": "dl",
    "jammu and kashmir": "jk", "chandigarh": "ch", "puducherry": "py", "pondicherry": "py",
}
SKELETON_DIGITS_B = [("0", "o"), ("1", "l"), ("3", "e"), ("4", "a"), ("5", "s"), ("6", "g"), ("8", "b")]
SKELETON_PAIRS_B = [("ph", "f"), ("bh", "b"), ("dh", "d"), ("th", "t"), ("kh", "k"), ("gh", "g"), ("sh", "s"), ("ch", "c"), ("ck", "k"), ("q", "k"), ("x", "ks"), ("z", "s"), ("c", "k"), ("w", "v"), ("v", "b")]

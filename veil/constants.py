"""Values that must be as they are for results to agree: names, word lists and patterns.

Patterns are written for Python; ``java`` gives the form that Spark takes.
"""

from __future__ import annotations

# Top-level domains that a bare domain may end in, as regex alternatives.
TLDS = (
    "com|net|org|edu|gov|mil|biz|info|name|museum|coop|aero|"
    "[a-z][a-z]|nl|uk|us|eu|de|fr|es|it|ru|cn|jp|br|pl|in|au|"
    "dev|app|io|ai|cloud|digital|tech|online|site|web|blog|shop|store|"
    "academy|agency|business|center|company|consulting|foundation|institute|"
    "international|management|marketing|solutions|technology|university|"
    "systems|services|support|science|software|studio|training|ventures|"
    "sharepoint|microsoft"
)

# Dutch words that are never entities.
DUTCH_STOP_WORDS = (
    "een het de die dat deze dit dan toen als maar want dus nog al naar door om bij aan van in op te ten ter met tot voor ben "
    "hoeven velden drie halfweg heel waarde zetten nuis leiden loop mijlpaal functioneel beheerder applicatiebeheerder medewerker collega afdeling"
).split()

# English words that are never entities.
ENGLISH_STOP_WORDS = "a an and at be for from has have in is it of on or that the their there this to was were with".split()

# The English seed lists. The Dutch lists are empty.
ENGLISH_NAMES = "John Jane Michael Sarah David Emily Robert Jessica William Olivia James Emma Daniel Sophia Matthew Isabella Christopher Mia Andrew Charlotte".split()
ENGLISH_LOCATIONS = (
    "New York|Los Angeles|Chicago|Houston|Phoenix|Philadelphia|San Antonio|San Diego|Dallas|San Jose|Seattle|Boston|Miami|Denver|Atlanta|Washington|San Francisco|Portland|Austin|Orlando"
).split("|")
ENGLISH_ORGANIZATIONS = (
    "Google|Microsoft|Amazon|Apple|Facebook|Netflix|Tesla|SpaceX|IBM|Intel|Oracle|Salesforce|Adobe|Uber|Airbnb|Visa|Mastercard|Coca-Cola|Pepsi|General Electric"
).split("|")

# Detector patterns.
_LABELS = r"(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)*[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
_TAIL = rf"\.(?:{TLDS})(?:/[^\s<>]*)?"
URL = rf"(?<![@\(\[])\b(?:(?:https?://(?:www\.)?|ftp://){_LABELS}{_TAIL}|(?<![@.])(?:www\.)?{_LABELS}{_TAIL})\b"
MARKDOWN_URL = r"(\[\[|\[)([^\]]*)(\]\]|\])\(([^)]+?|(?:[^)]*\([^)]*\)[^)]*))\)"
SHAREPOINT_URL = r"\bhttps?://[a-z0-9.-]*sharepoint\.com/(?:[^\s<>)\]]|\n)+"
PRIVATE_IP = r"\b(?:192\.168\.\d{1,3}\.\d{1,3}|10\.0\.\d{1,3}\.\d{1,3}|172\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
PUBLIC_IP = r"\b(?!(?:192\.168|10\.0|172\.(?:1[6-9]|2[0-9]|3[0-1]))\.\d{1,3}\.\d{1,3})(?:\d{1,3}\.){3}\d{1,3}\b"

# Definitions where the behaviour to match is a third-party library's. The local part of EMAIL, and ` at ` and ` dot `, are its public pattern as far as that is remembered.
EMAIL = (
    r"\b[a-z0-9!#$%&'*+/=?^_`{|}~-](?:[.a-z0-9!#$%&'*+/=?^_`{|}~-]{0,62}[a-z0-9!#$%&'*+/=?^_`{|}~-])?"
    r"(?:@|\sat\s)[a-z0-9](?:(?:[a-z0-9-]{0,62}[a-z0-9])?(?:\.|\sdot\s))+[a-z]{2,63}\b"
)
#: North American grouping, wherever it stands.
PHONE_GROUPS = r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}"
#: That grouping, or a Dutch number (national or +31) of ten digits; neither as a part of something longer.
PHONE = (
    rf"(?<![\w.+-])(?:{PHONE_GROUPS}"
    r"|(?:\+31[ -]?|0)(?:6[ -]?\d{8}|\d{2}[ -]\d{7}|\d{3}[ -]\d{6}))(?![\w-])"
)
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec"
DATE = (
    rf"(?:\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}(?:st|nd|rd|th)?\s(?:{MONTHS})\.?,?\s\d{{4}}|(?:{MONTHS})\.?\s\d{{1,2}}(?:st|nd|rd|th)?,?\s\d{{4}})"
)
BIRTH_WORDS = ("birth", "born", "dob", "d.o.b")
#: A date counts within so many characters after a birth word; its year makes an age of 18 to 100 in the year given.
BIRTH_REACH, YOUNGEST, OLDEST = 40, 18, 100
DATE_OF_BIRTH = rf"(?:birth|born|dob|d\.o\.b)[^\n]{{0,{BIRTH_REACH}}}?(?<![\w])({DATE})(?!\w)"

# Characters, lengths and marks of the gazetteer, of clean-up and of placeholders.
LETTERS = "0-9A-Za-zÀ-ÖØ-öø-ÿ"
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\u00ad"
UNKNOWN_ANGLE = r"<UNKNOWN-[^>]*>"
UNKNOWN_LINK = r"\[([^\]]+)\]\(UNKNOWN-\d+\)"
UNKNOWN_BARE = r"\bUNKNOWN-\d+\b"
GIBBERISH = r"[A-Za-z0-9_%=]{81,}"
GIBBERISH_HEAD, GIBBERISH_TAIL = 16, 8
MODULUS = 10000

#: Line ends of Python's splitlines, and the white space of its strip, for Java.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
OTHER_LINE_ENDS = "[\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
SPACE = "[\\s\\x1c-\\x1f]"


def java(pattern: str, flags: str = "") -> str:
    """The pattern with Unicode classes, as Python has them."""
    return f"(?U{flags})" + pattern

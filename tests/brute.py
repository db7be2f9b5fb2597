"""The scan rules once more, as two small tables that one function each reads.

``SHAPES`` says what a value of a type looks like, ``HIDES`` what of it stays readable. Both
are written from the rules' description, not from the library or its SQL.
"""

import re
from itertools import chain

# --- shapes: pieces of a value, put together ---------------------------------------------------


def n(what, low, high=None):
    """``low`` to ``high`` of a kind of character; "+" is without end."""
    times = {None: f"{{{low}}}", "+": f"{{{low},}}"}.get(high, f"{{{low},{high}}}")
    return f"[{what}]{times}"


def either(*options):
    return "(?:" + "|".join(options) + ")"


def maybe(*pieces):
    return "(?:" + "".join(pieces) + ")?"


def word(*pieces):
    """Pieces that no other word character touches."""
    return r"(?<!\w)(?=\w)" + "".join(pieces) + r"(?<=\w)(?!\w)"


DIGIT, ABC, HEX, GAP = r"\d", "A-Z", "a-f0-9", r"\s\-"
four, gap = n(DIGIT, 4), n(r"\s", 1)
any_gap, may_gap = n(GAP, 1), n(GAP, 0, 1)
colons = n(r"\s:", 0, "+")
octet = either("25[0-5]", r"2[0-4]\d", n("01", 0, 1) + n(DIGIT, 1, 2))
day = either("3[01]", r"[12]\d", "0?[1-9]")
month = either("1[0-2]", "0?[1-9]")
mobile = "[6-9]" + n(DIGIT, 9)
provider = either(*"""upi oksbi okaxis okicici okhdfcbank paytm ybl ibl axl waicici wahdfcbank""".split())

SHAPES = {
    "aadhaar": word(four, gap, four, gap, four),
    "pan": word(n(ABC, 5), n("0-9", 4), n(ABC, 1)),
    "phone": r"(?<!\d)" + maybe(r"\+91", may_gap) + mobile + r"(?!\d)",
    "us_phone": r"\b" + maybe(r"\+1", may_gap) + r"\(?" + n(DIGIT, 3) + r"\)?" + any_gap
    + n(DIGIT, 3) + any_gap + four + r"(?!\w)",
    "email": r"\b" + n(r"A-Z0-9._%+\-", 1, "+") + "@" + n(r"A-Z0-9.\-", 1, "+") + r"\." + n(ABC, 2, "+") + r"\b",
    "ip_address": word(r"\.".join([octet] * 4)),
    "passport": word(n(ABC, 1), n("0-9", 7)),
    "ifsc": word(n(ABC, 4), "0", n("A-Z0-9", 6)),
    "account_number": word("(?!" + mobile + r"(?!\w))", n(DIGIT, 9, 18)),
    "upi": r"\b" + n(r"A-Z0-9.\-_", 2, 256) + "@" + provider + r"(?!\w)",
    "credit_card": word((four + any_gap) * 3, four),
    "cvv": word("cvv", colons, n(DIGIT, 3, 4)),
    "expiry_date": word(either(r"0[1-9]", "1[0-2]"), "/", n("0-9", 2, 4)),
    "device_id": word(either("android", "ios"), "-", n(HEX, 8, "+")),
    "fingerprint": word("fp_hash_", n(HEX, 1, "+")),
    "face_template": word("face_tmp_", n(HEX, 1, "+")),
    "dob": word(day, "[/-]", month, "[/-]", either("19", "20"), n(DIGIT, 2)),
    "pincode": either("pin", "pincode", "zip") + colons + "[1-9]" + n("0-9", 5) + r"(?!\w)",
    "vehicle_number": word(n(ABC, 2), may_gap, n(DIGIT, 2), may_gap, n(ABC, 1, 2), may_gap, four),
    "voter_id": word(n(ABC, 3), n("0-9", 7)),
    "gstin": word(n(DIGIT, 2), n(ABC, 5), four, n(ABC, 1), "[1-9A-Z]Z[0-9A-Z]"),
    "swift_code": either("swift", "bic") + n(r"\s:", 1, "+") + n(ABC, 6) + n("A-Z0-9", 2) + maybe(n("A-Z0-9", 3)),
}
streets = """Road Street Nagar Colony Sector Phase Block Avenue Lane Marg Chowk Layout Extension
    Society Residency Apartments? Towers? Floor Flat Plot""".split()
ADDRESS = r"\b\d+" + n(r",\s", 1) + n(r"A-Z0-9\s,\-.", 1, "+") + either(*streets) + n(r"^.\n", 0, 60)
surname = n(ABC, 1) + n("a-z", 1, "+")
NAME = (
    r"(?<!\w)" + either(*(t + r"\.?" for t in ("Mr", "Mrs", "Ms", "Dr", "Prof", "Smt")), "Shri", "Sri")
    + n(r"\s", 1, "+") + surname + f"(?:{n(chr(92) + 's', 1, '+')}{surname}){{0,2}}" + r"(?!\w)"
)

# --- what stays readable: how many characters in front, how many behind, what stands between ---


def at(sign):
    return lambda v: v.index(sign)


def from_(sign):
    return lambda v: len(v) - v.index(sign)


def country(v):
    return 4 if v[:3] == "+91" else 1


def hidden(value, head, tail, filler):
    """One character of filler goes over each hidden one; a longer filler stands for all."""
    head, tail = (k(value) if callable(k) else k for k in (head, tail))
    over = max(0, len(value) - head - tail)
    return value[:head] + (filler * over if len(filler) == 1 else filler) + value[len(value) - tail :]


def digits_only(value):
    return "".join(c for c in value if c not in " -()")


def inside(shape, filler):
    return lambda v: re.sub(shape, filler, v, flags=re.IGNORECASE)


def every_part(sign, skip, *rule):
    return lambda v: sign.join(chain(v.split(sign)[:skip], (hidden(p, *rule) for p in v.split(sign)[skip:])))


def mail(value):
    user, host = value.split("@")
    return every_part(".", 0, 1, 0, "*")(user) + "@" + host


HIDES = {
    "aadhaar": (4, 0, " XXXX XXXX"), "pan": (2, 5, "X"), "phone": (country, 2, "X"),
    "us_phone": (digits_only, 0, 4, "***-***-"), "email": mail, "ip_address": every_part(".", 1, 0, 0, "X"),
    "passport": (1, 0, "X" * 7), "ifsc": (4, 0, "0" + "X" * 6), "account_number": (0, 4, "X"),
    "upi": (1, from_("@"), "***"), "credit_card": (digits_only, 4, 4, " **** **** "),
    "cvv": inside(r"\d{3,4}", "***"), "expiry_date": (0, from_("/"), "**"),
    "device_id": (at("-"), 0, "-" + "X" * 8), "fingerprint": (0, 0, "fp_hash_" + "X" * 8),
    "face_template": (0, 0, "face_tmp_" + "X" * 8), "dob": (0, 0, "[DOB REDACTED]"),
    "pincode": inside("[1-9][0-9]{5}", "X" * 6), "vehicle_number": (0, 0, "[VEHICLE REDACTED]"),
    "voter_id": (0, 0, "[VOTER ID REDACTED]"), "gstin": (0, 0, "[GSTIN REDACTED]"),
    "swift_code": inside("[A-Z]{6}[A-Z0-9]{2,5}", "[SWIFT REDACTED]"), "name": (0, 0, "[NAME REDACTED]"),
    "address": (lambda v: re.match(r"\d+", v).end(), 0, ", ***, ***, ***"),
}


def mask(kind, value):
    rule = HIDES[kind]
    if callable(rule):
        return rule(value)
    if len(rule) == 4:
        value, rule = rule[0](value), rule[1:]
    return hidden(value, *rule)


# --- scans -------------------------------------------------------------------------------------


def hits(kind, shape, text, flags=re.IGNORECASE):
    return [(kind, m.group(), mask(kind, m.group())) for m in re.finditer(shape, text, flags)]


def structured(text):
    return list(chain.from_iterable(hits(kind, shape, text) for kind, shape in SHAPES.items()))


def addresses(text):
    seen = (m.group().strip() for m in re.finditer(ADDRESS, text, re.IGNORECASE))
    return [("address", v, mask("address", v)) for v in seen if len(v) > 10]


def contextual(text):
    return hits("name", NAME, text, 0) + addresses(text)


def apply(text, detections):
    for _, value, shown in detections:
        before, found, after = text.partition(value)
        text = before + shown + after if found else text
    return text


def full(text):
    out = []
    for step in (structured, contextual):
        found = step(text)
        text, out = apply(text, found), out + found
    return text, out

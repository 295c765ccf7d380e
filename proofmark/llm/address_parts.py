"""Reading one postal address into parts: number, direction, street, kind of street, unit, town,
state, ZIP code. The firm in front, roles and the country say nothing about the premises."""

from __future__ import annotations

import re
import unicodedata

# Standard abbreviations of the post. Everything else is mined from the data.
STREET_KINDS = {"STREET": "ST STR STREETS", "AVENUE": "AVE AV AVEN", "ROAD": "RD", "LANE": "LN", "DRIVE": "DR DRV", "BOULEVARD": "BLVD BOUL BLV", "COURT": "CT CRT", "HIGHWAY": "HWY HIWAY HWAY", "PLACE": "PL", "SQUARE": "SQ", "TERRACE": "TER TERR", "PARKWAY": "PKWY PKY", "CIRCLE": "CIR", "TRAIL": "TRL", "WAY": "WY", "ALLEY": "ALY"}
DIRECTIONS = {"NORTH": "N NO NTH", "SOUTH": "S SO STH", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW"}
TOWN_WORDS = {"MOUNT": "MT MNT", "FORT": "FT", "SAINT": "ST", "JUNCTION": "JCT JCTN JUNC", "SPRINGS": "SPGS SPG SPRGS SPRING", "FALLS": "FLS FL", "HEIGHTS": "HTS HGTS", "VILLAGE": "VLG", "CENTER": "CTR CENTRE", "PORT": "PT", "BEACH": "BCH", "LAKE": "LK", "POINT": "PNT"}
UNIT_WORDS = "SUITE STE UNIT APT APARTMENT ROOM RM BLDG BUILDING FLOOR FL FLR DEPT DOCK BAY LOT".split()
UNIT_ALONE = "REAR UPPER LOWER FRONT BASEMENT".split()
NUMBER_WORDS = "NO NR NUMBER NUM NBR".split()
COUNTRIES = ["USA", "US", "UNITED STATES OF AMERICA", "UNITED STATES", "U S A", "U S"]
STATES = dict(
    x.split(":")
    for x in "ALABAMA:AL;ALASKA:AK;ARIZONA:AZ;ARKANSAS:AR;CALIFORNIA:CA;COLORADO:CO;CONNECTICUT:CT;DELAWARE:DE;FLORIDA:FL;GEORGIA:GA;HAWAII:HI;IDAHO:ID;ILLINOIS:IL;INDIANA:IN;IOWA:IA;KANSAS:KS;KENTUCKY:KY;LOUISIANA:LA;MAINE:ME;MARYLAND:MD;MASSACHUSETTS:MA;MICHIGAN:MI;MINNESOTA:MN;MISSISSIPPI:MS;MISSOURI:MO;MONTANA:MT;NEBRASKA:NE;NEVADA:NV;NEW HAMPSHIRE:NH;NEW JERSEY:NJ;NEW MEXICO:NM;NEW YORK:NY;NORTH CAROLINA:NC;NORTH DAKOTA:ND;OHIO:OH;OKLAHOMA:OK;OREGON:OR;PENNSYLVANIA:PA;RHODE ISLAND:RI;SOUTH CAROLINA:SC;SOUTH DAKOTA:SD;TENNESSEE:TN;TEXAS:TX;UTAH:UT;VERMONT:VT;VIRGINIA:VA;WASHINGTON:WA;WEST VIRGINIA:WV;WISCONSIN:WI;WYOMING:WY".split(";")
)
CODES = set(STATES.values())
KIND = {a: k for k, v in STREET_KINDS.items() for a in [k, *v.split()]}
DIRECTION = {a: k for k, v in DIRECTIONS.items() for a in [k, *v.split()]}
TOWN_WORD = {a: k for k, v in TOWN_WORDS.items() for a in [k, *v.split()]}
BREAK = "|"


def tokens_of(text: str) -> list[str]:
    """Upper-case words and numbers with `|` where the text has a comma, semicolon, slash or line break."""
    s = unicodedata.normalize("NFKD", text).upper()
    s = "".join(c for c in s if not unicodedata.combining(c))
    s = re.sub(r"\bU\.\s?S\.(?:\s?A\.)?", " USA ", s)
    s = re.sub(r"#\s*", " UNIT ", s)
    s = re.sub(r"\bC/O\b", " ", s)
    s = re.sub(r"\b(?:[A-Z]+ED\s+AND\s+)?[A-Z]{4,}ED\s+BY\b", f" {BREAK} ", s)  # the firm's role
    s = re.sub(r"[,;/\n\r|]+", f" {BREAK} ", s)
    s = re.sub(r"(?<=[A-Z])[.'’](?=[A-Z])|['’]", "", s)
    s = re.sub(r"(?<=\d)-(?=\d{4}\b)", "+", s)
    s = re.sub(r"[^A-Z0-9+| ]", " ", s)
    for c in COUNTRIES:
        s = re.sub(rf"\b{c}\s*$", f" {BREAK} ", s.rstrip(" |")) if s.rstrip(" |").endswith(c) else s
    out: list[str] = []
    for t in s.split():
        if t == BREAK and (not out or out[-1] == BREAK):
            continue
        out.append(t)
    while out and out[-1] == BREAK:
        out.pop()
    return out


def _fix(tokens: list[str], rewrites: dict[str, str]) -> list[str]:
    return [rewrites.get(t, t) for t in tokens] if rewrites else tokens


ZIP = re.compile(r"\d{5}(\+\d{4})?")
#: Codes that are words as well; alone they count as states only where a ZIP code, a break or the end follows.
WORDS_TOO = {"MT", "CO", "OR", "IN", "ME", "OK", "HI", "LA", "DE", "PA", "MA", "AL", "ID"}
FIRM_WORDS = {"BREWING", "BREW", "TRADING", "TRADG", "AND", "DISTILLING", "BOTTLING"}


def _states(tokens: list[str]) -> list[str]:
    """State names as codes marked with `=`. A name or code is a state after a word where a ZIP
    code, a number, a break or the end follows; CT and the like are kinds of street where a
    number and a name stand before them or a house number behind; CO may be a firm's."""
    out, i = [], 0
    while i < len(tokens):
        t, two = tokens[i], " ".join(tokens[i : i + 2])
        after_word = bool(out) and (out[-1] == BREAK or not out[-1][0].isdigit())
        end = lambda k: i + k >= len(tokens) or tokens[i + k] == BREAK
        zip_code = lambda k: i + k < len(tokens) and ZIP.fullmatch(tokens[i + k]) is not None
        number = lambda k: i + k < len(tokens) and tokens[i + k].isdigit()
        if two in STATES and after_word and (end(2) or zip_code(2) or number(2)):
            out.append("=" + STATES[two])
            i += 2
            continue
        if t in STATES and after_word and out[-1] not in DIRECTION and (end(1) or zip_code(1) or number(1)):
            out.append("=" + STATES[t])
        elif t in CODES and after_word:
            street_kind = t in KIND and (_street_before(out) or (number(1) and not zip_code(1)))
            firm = t == "CO" and (out[-1] in FIRM_WORDS or _place_earlier(out) or (number(1) and (not zip_code(1) or _place_later(tokens[i + 2 :]) or not end(2))) or (end(1) and _place_later(tokens[i + 1 :]) and not zip_code(2)))
            state = end(1) or zip_code(1) or number(1) or t not in WORDS_TOO
            out.append("=" + t if state and not street_kind and not firm else t)
        else:
            out.append(t)
        i += 1
    return out


def _place_later(rest: list[str]) -> bool:
    """Whether a state or another ZIP code still comes."""
    return any((x in CODES and x not in KIND) or x in STATES or (k and ZIP.fullmatch(x)) for k, x in enumerate(rest))


def _place_earlier(out: list[str]) -> bool:
    """Whether a state or a ZIP code behind a word came already."""
    return any(x.startswith("=") or (k and ZIP.fullmatch(x) and not out[k - 1][0].isdigit() and (k + 1 == len(out) or out[k + 1] == BREAK)) for k, x in enumerate(out))


def _street_before(out: list[str]) -> bool:
    """Whether a house number, perhaps a direction, and a name stand last."""
    tail = out[-3:]
    return (len(tail) >= 2 and tail[-2].isdigit()) or (len(tail) == 3 and tail[0].isdigit() and tail[1] in DIRECTION)


def parse(text: str | None, rewrites: dict[str, str] | None = None, streets_known: dict[str, int] | None = None) -> dict[str, str | None]:
    """Parts of an address; parts that are absent or can't be told are null. streets_known:
    counts of street names, to tell on which side of the number the street stands."""
    got: dict[str, str | None] = dict.fromkeys(("number", "direction", "street", "kind", "town", "state", "zip"))
    if not text:
        return got
    toks = _states(_fix(tokens_of(text), rewrites or {}))
    # units: word and value, or a word alone
    clean: list[str] = []
    i = 0
    while i < len(toks):
        t = toks[i]
        nxt = toks[i + 1] if i + 1 < len(toks) else ""
        if t in UNIT_WORDS and re.fullmatch(r"\d{1,4}[A-Z]?|[A-Z]", nxt) and not (t == "FL" and len(nxt) > 2):
            i += 2
            if clean and clean[-1] != BREAK:
                clean.append(BREAK)
            continue
        if t in UNIT_ALONE and (t in ("REAR", "BASEMENT") or nxt in ("", BREAK) or (clean and (clean[-1] in KIND or clean[-1] in DIRECTION or clean[-1].isdigit()))):
            i += 1
            if clean and clean[-1] != BREAK:
                clean.append(BREAK)
            continue
        clean.append(t)
        i += 1
    toks = clean
    # ZIP code
    numbers = [k for k, t in enumerate(toks) if t[0].isdigit()]
    zips = [k for k in numbers if re.fullmatch(r"\d{5}\+\d{4}", toks[k]) or (re.fullmatch(r"\d{5}", toks[k]) and k and toks[k - 1].startswith("="))]
    if not zips:
        five = [k for k in numbers if re.fullmatch(r"\d{5}", toks[k])]
        other = [k for k in numbers if k not in five and re.fullmatch(r"\d{1,6}", toks[k])]
        if five and (other or len(five) > 1):
            # not the one a street follows
            ends = [k for k in five if k + 1 >= len(toks) or toks[k + 1] == BREAK]
            zips = [(ends or five)[-1]] if other or ends else []
    if zips:
        z = zips[-1]
        got["zip"] = toks[z].split("+")[0]
    streets = [k for k in numbers if k not in zips[-1:] and re.fullmatch(r"\d{1,6}", toks[k])]
    streets = streets or [k for k in numbers if k not in zips[-1:] and re.fullmatch(r"\d{1,6}[A-Z]", toks[k])]  # 221B
    marked = [k for k in streets if k and toks[k - 1] in NUMBER_WORDS]
    n = (marked or streets or [None])[0] if len(streets) < 2 or marked else _best_number(toks, streets)
    used: set[int] = set(zips[-1:])
    if n is not None:
        got["number"] = toks[n].lstrip("0") or "0"
        used.add(n)
        if n and toks[n - 1] in NUMBER_WORDS and n in marked:
            used.add(n - 1)
        after = []
        k = n + 1
        while k < len(toks) and toks[k] != BREAK and not toks[k].startswith("=") and k not in used:
            after.append(k)
            k += 1
        before = []
        k = min([n, *[u for u in used if u == n - 1]]) - 1
        while k >= 0 and toks[k] != BREAK and not toks[k].startswith("=") and k not in used:
            before.insert(0, k)
            k -= 1
        if after and not (before and _stands_before([toks[k] for k in before], [toks[k] for k in after], streets_known or {})):
            _forward(toks, after, got, used)
        else:
            _backward(toks, before, got, used)
    # town and state
    s = [k for k, t in enumerate(toks) if t.startswith("=")]
    if s:
        got["state"] = toks[s[-1]][1:]
        used.update(s)
        end = s[-1]
    elif zips:
        end = zips[-1]
    else:
        end = len(toks)
    got["town"] = _town(toks, end, used, n)
    return got


def _best_number(toks: list[str], streets: list[int]) -> int:
    """Of several numbers the one a kind of street follows or precedes, else the first."""
    for k in streets:
        near = [t for t in toks[k + 1 : k + 4]]
        if BREAK in near:
            near = near[: near.index(BREAK)]
        if any(t in KIND for t in near):
            return k
    for k in streets:
        if any(t in KIND for t in toks[max(0, k - 3) : k]):
            return k
    return streets[0]


def _forward(toks: list[str], after: list[int], got: dict, used: set[int]) -> None:
    """NUMBER [direction] NAME [kind] [direction], the town may follow without a break."""
    k = 0
    if len(after) > 1 and toks[after[0]] in DIRECTION:
        got["direction"] = DIRECTION[toks[after[0]]]
        used.add(after[0])
        k = 1
    if k >= len(after):
        return
    got["street"] = toks[after[k]]
    used.add(after[k])
    k += 1
    # further words of the name, up to a kind of street two words on at most
    for far in (0, 1):
        if k + far < len(after) and toks[after[k + far]] in KIND:
            kind = toks[after[k + far]]
            if far and toks[after[k]] in TOWN_WORD:
                break
            for j in range(k, k + far):
                got["street"] += " " + toks[after[j]]
                used.add(after[j])
            got["kind"] = KIND[kind]
            used.add(after[k + far])
            k += far + 1
            break
    if k < len(after) and toks[after[k]] in DIRECTION and got["direction"] is None:
        got["direction"] = DIRECTION[toks[after[k]]]
        used.add(after[k])


def _stands_before(before: list[str], after: list[str], known: dict[str, int]) -> bool:
    """Whether the street stands before the number though words follow it."""
    ahead = [t for t in after[:3] if t not in DIRECTION]
    if len(ahead) > 1 and ahead[1] in KIND and ahead[1] != "ST":
        return False
    tail = [t for t in before[-3:] if t not in DIRECTION]
    name = tail[-2] if len(tail) > 1 and tail[-1] in KIND else tail[-1] if tail else ""
    if len(tail) > 1 and tail[-1] in KIND and (not known or known.get(name, 0) >= known.get(ahead[0] if ahead else "", 0)):
        return True
    if ahead and ahead[0] in ("SAINT", "MOUNT", "MT", "FORT", "FT") and name and not known.get(ahead[0]):
        return True  # a town follows the number
    return known.get(name, 0) > known.get(ahead[0] if ahead else "", 0)


def _backward(toks: list[str], before: list[int], got: dict, used: set[int]) -> None:
    """NAME [kind] [direction] NUMBER, read from the number backwards."""
    k = len(before) - 1
    if k >= 0 and toks[before[k]] in DIRECTION:
        got["direction"] = DIRECTION[toks[before[k]]]
        used.add(before[k])
        k -= 1
    if k >= 1 and toks[before[k]] in KIND:
        got["kind"] = KIND[toks[before[k]]]
        used.add(before[k])
        k -= 1
    if k >= 0:
        got["street"] = toks[before[k]]
        used.add(before[k])
        k -= 1
    if k >= 0 and toks[before[k]] in DIRECTION and got["direction"] is None:
        got["direction"] = DIRECTION[toks[before[k]]]
        used.add(before[k])


def _town(toks: list[str], end: int, used: set[int], number: int | None) -> str | None:
    """Words that stand before the state or ZIP code, back to a break or what is used."""
    words: list[str] = []
    k = end - 1
    while k >= 0 and toks[k] == BREAK:
        k -= 1
    while k >= 0 and toks[k] != BREAK and k not in used and not toks[k][0].isdigit():
        words.insert(0, toks[k])
        k -= 1
    if not words and end < len(toks):
        # the state or ZIP code may stand apart: the last free words anywhere
        return None
    # without breaks the firm may run into the town: at most prefix, name and suffix are the town
    if len(words) > 3 or (k < 0 and number is not None and number > end):
        words = _tail_town(words)
    if words and words[0] in ("SAINT", "ST", "MOUNT", "MT", "FORT", "FT") or len(words) <= 3:
        return " ".join(_spell(words)) or None
    return " ".join(_spell(_tail_town(words))) or None


def _tail_town(words: list[str]) -> list[str]:
    k = len(words) - 1
    if k >= 1 and TOWN_WORD.get(words[k]) in ("JUNCTION", "SPRINGS", "FALLS", "HEIGHTS", "VILLAGE", "CENTER", "BEACH"):
        k -= 1
    if k >= 1 and TOWN_WORD.get(words[k - 1]) in ("MOUNT", "FORT", "SAINT", "PORT", "LAKE"):
        k -= 1
    return words[max(0, k) :]


def _spell(words: list[str]) -> list[str]:
    return [TOWN_WORD.get(w, w) for w in words]

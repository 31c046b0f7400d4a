"""Parsers of personal documents: each gives quads as plain tuples ``(s, p, o, g)``."""

from __future__ import annotations

import email
import email.policy
import email.utils
import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

from ..model import PERSONAL, SCHEMA, SAME_AS, TYPE, XSD

Quad = tuple[str, str, str, str]


def term(text: str, datatype: str | None = None, lang: str | None = None) -> str:
    body = text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    return f'"{body}"' + (f"@{lang}" if lang else f"^^<{XSD}{datatype}>" if datatype else "")


def _p(name: str) -> str:
    return f"<{SCHEMA}{name}>"


def name_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('|'.join(parts).encode()).digest(), version=3)}>"


def unfolded(text: str) -> list[tuple[str, dict[str, list[str]], str]]:
    """Content lines: name, parameters, value."""
    out = []
    for line in re.sub(r"\r?\n[ \t]", "", text).splitlines():
        head, colon, value = line.partition(":")
        if not colon:
            continue
        while head.count('"') % 2:  # a colon inside a quoted parameter
            more, _, value = value.partition(":")
            head += ":" + more
        name, *params = re.split(r';(?=(?:[^"]*"[^"]*")*[^"]*$)', head)
        found: dict[str, list[str]] = {}
        for p in params:
            k, _, v = p.partition("=")
            found.setdefault(k.upper() if v else "TYPE", []).extend(x.strip('"').upper() for x in (v or k).split(","))
        out.append((name.rpartition(".")[2].upper(), found, value))
    return out


def unescaped(value: str) -> str:
    return re.sub(r"\\([\\,;nN])", lambda m: "\n" if m[1] in "nN" else m[1], value)


def _split(value: str, by: str) -> list[str]:
    return [unescaped(x) for x in re.split(rf"(?<!\\){by}", value)]


def address_quads(subject: str, street: str, locality: str, region: str, code: str, country: str, g: str) -> list[Quad]:
    out: list[Quad] = []
    parent, path = None, []
    for kind, value in (("Country", country), ("State", region), ("City", locality)):
        if value:
            path.append(value)
            place = name_id("place", *path)
            out += [(place, TYPE, _p(kind), g), (place, _p("name"), term(value), g)]
            if parent:
                out.append((place, _p("containedInPlace"), parent, g))
            parent = place
    node = name_id("address", street, *path, code)
    out += [(subject, _p("address"), node, g), (node, TYPE, _p("PostalAddress"), g)]
    for p, value in (("streetAddress", street), ("postalCode", code)):
        if value:
            out.append((node, _p(p), term(value), g))
    if parent:
        out.append((node, _p("addressLocality"), parent, g))
    return out


def parse_vcard(data: bytes, iri: str) -> list[Quad]:
    return list(vcard_quads(data, iri))


def blocks(data: bytes, kind: str) -> Iterator[str]:
    """The texts between BEGIN and END of a kind, one at a time; only the one in hand is decoded."""
    for m in re.finditer(rb"(?is)BEGIN:%b(.*?)END:%b" % (kind.encode(), kind.encode()), data):
        yield m[1].decode("utf-8", "replace")


def vcard_quads(data: bytes, iri: str) -> Iterator[Quad]:
    g = f"<{iri}>"
    for n, card in enumerate(blocks(data, "VCARD")):
        out: list[Quad] = []
        lines = unfolded(card)
        uid = next((v for k, _, v in lines if k == "UID"), f"{iri}#{n}")
        s = name_id("vcard", uid)
        out.append((s, TYPE, f"<{PERSONAL}Agent>", g))
        for key, params, value in lines:
            text = unescaped(value)
            if key == "FN":
                out.append((s, _p("name"), term(text), g))
            elif key == "N":
                for p, x in zip(("familyName", "givenName", "additionalName", "honorificPrefix", "honorificSuffix"), _split(value, ";"), strict=False):
                    out += [(s, _p(p), term(y), g) for y in x.split(",") if y]
            elif key == "NICKNAME":
                out += [(s, _p("alternateName"), term(x), g) for x in _split(value, ",") if x]
            elif key == "EMAIL":
                address = text.removeprefix("mailto:")
                if "@" in address:
                    node = f"<mailto:{address.lower()}>"
                    out += [(s, _p("email"), node, g), (node, TYPE, f"<{PERSONAL}EmailAddress>", g), (node, _p("name"), term(address), g)]
            elif key == "TEL":
                number = re.sub(r"[\s().-]", "", text.removeprefix("tel:"))
                if re.fullmatch(r"0[1-9]\d{8}", number):
                    number = "+33" + number[1:]
                if re.fullmatch(r"\+\d{6,15}", number):
                    kind = "CellphoneNumber" if "CELL" in params.get("TYPE", ()) else "FaxNumber" if "FAX" in params.get("TYPE", ()) else "PhoneNumber"
                    out += [(s, _p("telephone"), f"<tel:{number}>", g), (f"<tel:{number}>", TYPE, f"<{PERSONAL}{kind}>", g)]
            elif key == "ADR":
                box, extended, street, locality, region, code, country = (_split(value, ";") + [""] * 7)[:7]
                out += address_quads(s, " ".join(x for x in (box, extended, street) if x), locality, region, code, country, g)
            elif key in ("BDAY", "DEATHDATE"):
                p = "birthDate" if key == "BDAY" else "deathDate"
                m = re.fullmatch(r"(\d{4}|--)-?(\d{2})-?(\d{2})(T.*)?", text)
                if m:
                    date = f"--{m[2]}-{m[3]}" if m[1] in ("--", "1970") else f"{m[1]}-{m[2]}-{m[3]}"
                    out.append((s, _p(p), term(date, "gMonthDay" if date.startswith("--") else "date"), g))
            elif key == "ORG":
                org = name_id("organization", *_split(value, ";"))
                out += [(s, _p("worksFor"), org, g), (org, TYPE, _p("Organization"), g), (org, _p("name"), term(_split(value, ";")[0]), g)]
            elif key == "TITLE":
                out.append((s, _p("jobTitle"), term(text), g))
            elif key == "PHOTO":
                kind = (params.get("TYPE") or ["JPEG"])[0].lower()
                out.append((s, _p("image"), f"<{value if value.startswith(('data:', 'http')) else f'data:image/{kind};base64,{value}'}>", g))
            elif key in ("URL", "X-SOCIALPROFILE") and re.match(r"\w+:\S+$", text):
                out.append((s, _p("url"), f"<{text}>", g))
        yield from out


#: Single-valued text lines that a diff on a card can change.
_CARD_LINES = {_p("name"): "FN", _p("jobTitle"): "TITLE", _p("alternateName"): "NICKNAME", _p("email"): "EMAIL", _p("telephone"): "TEL", _p("url"): "URL"}


def apply_to_vcard(text: str, removed: list[tuple[str, str]], added: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str, str, str | None]]]:
    """A card after removals and then additions of (predicate, object), and their outcomes
    ``(side, predicate, object, error)``."""
    lines = re.sub(r"\r?\n[ \t]", "", text).splitlines()
    results = []

    def plain(o: str) -> str:
        return re.sub(r"^(<(mailto:|tel:)?|\")|(>|\"(@[\w-]+|\^\^<.*>)?)$", "", o)

    def same(line: str, key: str, value: str) -> bool:
        head, _, own = line.partition(":")
        own = unescaped(own)
        if key == "TEL":
            own = re.sub(r"[\s().-]", "", own)
            own = "+33" + own[1:] if re.fullmatch(r"0[1-9]\d{8}", own) else own
        return head.partition(";")[0].upper() == key and own.removeprefix("mailto:").lower() == value.lower()

    for p, o in removed:
        key, value = _CARD_LINES.get(p), plain(o)
        if key is None:
            results.append(("removed", p, o, "not supported"))
            continue
        kept = []
        for line in lines:
            if key == "NICKNAME" and line.upper().startswith("NICKNAME"):
                head, _, own = line.partition(":")
                rest = [x for x in _split(own, ",") if x != value]
                if rest:
                    kept.append(f"{head}:{','.join(rest)}")
            elif not same(line, key, value):
                kept.append(line)
        results.append(("removed", p, o, None if kept != lines else "not found"))
        lines = kept
    for p, o in added:
        key, value = _CARD_LINES.get(p), plain(o)
        if key is None:
            results.append(("added", p, o, "not supported"))
            continue
        nick = next((i for i, x in enumerate(lines) if key == "NICKNAME" and x.upper().startswith("NICKNAME")), None)
        if nick is not None:
            lines[nick] += "," + value
        elif not any(same(x, key, value) for x in lines):
            end = next((i for i, x in enumerate(lines) if x.upper().startswith("END:VCARD")), len(lines))
            lines.insert(end, f"{key}:{value}")
        results.append(("added", p, o, None))
    return "\r\n".join(lines) + "\r\n", results


def _ical_time(value: str, params: dict) -> str | None:
    m = re.fullmatch(r"(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2})(Z?))?", value)
    if not m:
        return None
    if m[4] is None:
        return term(f"{m[1]}-{m[2]}-{m[3]}", "date")
    return term(f"{m[1]}-{m[2]}-{m[3]}T{m[4]}:{m[5]}:{m[6]}Z", "dateTime")


def parse_ical(data: bytes, iri: str) -> list[Quad]:
    return list(ical_quads(data, iri))


def ical_quads(data: bytes, iri: str) -> Iterator[Quad]:
    g = f"<{iri}>"
    for block in blocks(data, "VEVENT"):
        out: list[Quad] = []
        block = re.sub(r"(?is)BEGIN:VALARM.*?END:VALARM", "", block)
        lines = unfolded(block)
        first = lambda k, own=lines: next((v for n, _, v in own if n == k), "")
        s = name_id("event", first("UID"), first("RECURRENCE-ID"), first("SEQUENCE"))
        out.append((s, TYPE, _p("Event"), g))
        for key, params, value in lines:
            text = unescaped(value)
            if key in ("SUMMARY", "DESCRIPTION"):
                out.append((s, _p("name" if key == "SUMMARY" else "description"), term(text), g))
            elif key in ("DTSTART", "DTEND"):
                if o := _ical_time(value, params):
                    out.append((s, _p("startDate" if key == "DTSTART" else "endDate"), o, g))
            elif key == "DURATION":
                m = re.fullmatch(r"([+-]?)P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?", value)
                if m:
                    days = 7 * int(m[2] or 0) + int(m[3] or 0)
                    out.append((s, _p("duration"), term(f"{m[1].replace('+', '')}P{days}DT{int(m[4] or 0)}H{int(m[5] or 0)}M{int(m[6] or 0)}S", "dayTimeDuration"), g))
            elif key == "LOCATION" and text:
                place = name_id("place", text)
                out += [(s, _p("location"), place, g), (place, TYPE, _p("Place"), g), (place, _p("name"), term(text), g)]
            elif key == "X-APPLE-STRUCTURED-LOCATION" and text.startswith("geo:"):
                place = name_id("place", first("LOCATION") or text)
                out += [(s, _p("location"), place, g), (place, TYPE, _p("Place"), g), (place, _p("geo"), f"<{text}>", g)]
            elif key in ("ORGANIZER", "ATTENDEE"):
                address = re.sub(r"(?i)^mailto:", "", text)
                if "@" in address:
                    agent = name_id("agent", address.lower(), next((v[0] for k, v in params.items() if k == "CN"), ""))
                    out += [(s, _p("organizer" if key == "ORGANIZER" else "attendee"), agent, g), (agent, TYPE, f"<{PERSONAL}Agent>", g), (agent, _p("email"), f"<mailto:{address.lower()}>", g)]
            elif key == "URL" and re.match(r"\w+:\S+$", text):
                out.append((s, _p("url"), f"<{text}>", g))
        yield from out


def parse_email(data: bytes, iri: str, with_body: bool = False) -> list[Quad]:
    """A message: recipients have their own role and the generic one; attachments are skipped."""
    g = f"<{iri}>"
    message = email.message_from_bytes(data, policy=email.policy.default)
    own = re.fullmatch(r"\s*<(.+)>\s*", str(message.get("Message-ID", "")))
    s = f"<mid:{own[1]}>" if own else name_id("message", hashlib.md5(data).hexdigest())
    out: list[Quad] = [(s, TYPE, _p("EmailMessage"), g)]
    if message.get("Subject"):
        out.append((s, _p("headline"), term(str(message["Subject"])), g))
    try:
        out.append((s, _p("dateSent"), term(email.utils.parsedate_to_datetime(str(message["Date"])).isoformat(), "dateTime"), g))
    except (TypeError, ValueError):
        pass
    roles = {"From": ["sender"], "To": ["toRecipient", "recipient"], "Cc": ["ccRecipient", "recipient"], "Bcc": ["bccRecipient", "recipient"]}
    for header, names in roles.items():
        for name, address in email.utils.getaddresses([str(v) for v in message.get_all(header, [])]):
            if "@" not in address or address.lower().startswith("undisclosed-recipients"):
                continue
            name = re.sub(r"\s", " ", name.strip().strip("\"'")).replace(f"({address})", "").replace(f"<{address}>", "").strip()
            agent = name_id("agent", address.lower(), name)
            out += [(s, f"<{PERSONAL}{n}>" if n.endswith("Recipient") else _p(n), agent, g) for n in names]
            out += [(agent, TYPE, f"<{PERSONAL}Agent>", g), (agent, _p("email"), f"<mailto:{address.lower()}>", g)]
            if name and name.lower() != address.lower():
                out.append((agent, _p("name"), term(name), g))
    for ref in str(message.get("In-Reply-To", "")).split():
        if m := re.fullmatch(r"<(.+)>", ref):
            out.append((s, f"<{PERSONAL}inReplyTo>", f"<mid:{m[1]}>", g))
    if with_body and (part := message.get_body(preferencelist=("plain",))) is not None:
        out.append((s, _p("text"), term(part.get_content()), g))
    return list(dict.fromkeys(out))


def parse_social(data: bytes, iri: str) -> list[Quad]:
    """An event of a social graph with its place and guests by their answers."""
    g, event = f"<{iri}>", json.loads(data)
    s = f"<urn:social:{event['id']}>"
    out: list[Quad] = [(s, TYPE, _p("Event"), g)]
    for key, p in (("name", "name"), ("description", "description")):
        if event.get(key):
            out.append((s, _p(p), term(event[key]), g))
    for key, p in (("start_time", "startDate"), ("end_time", "endDate")):
        if event.get(key):
            out.append((s, _p(p), term(re.sub(r"([+-]\d{2})(\d{2})$", r"\1:\2", event[key]), "dateTime"), g))
    place = event.get("place") or {}
    if place.get("name"):
        node = f"<urn:social:{place['id']}>" if place.get("id") else name_id("place", place["name"])
        out += [(s, _p("location"), node, g), (node, TYPE, _p("Place"), g), (node, _p("name"), term(place["name"]), g)]
        at = place.get("location") or {}
        if "latitude" in at and "longitude" in at:
            out.append((node, _p("geo"), f"<geo:{at['latitude']},{at['longitude']}>", g))
        if at.get("street") or at.get("city"):
            out += address_quads(node, at.get("street", ""), at.get("city", ""), at.get("state", ""), at.get("zip", ""), at.get("country", ""), g)
    for role, p in (("attending", "attendee"), ("maybe", "maybeAttendee"), ("declined", "declinedAttendee"), ("noreply", "invitee")):
        for guest in (event.get(role) or {}).get("data", []):
            agent = f"<urn:social:{guest['id']}>"
            out += [(s, _p(p) if p == "attendee" else f"<{PERSONAL}{p}>", agent, g), (agent, TYPE, f"<{PERSONAL}Agent>", g), (agent, _p("name"), term(guest["name"]), g)]
    return out


def parse_social_profile(data: bytes, iri: str) -> list[Quad]:
    """A profile of a social graph: names, addresses, birthday, home town, web page and picture."""
    g, own = f"<{iri}>", json.loads(data)
    s = f"<urn:social:{own['id']}>"
    out: list[Quad] = [(s, TYPE, f"<{PERSONAL}Agent>", g)]
    for key, p in (("name", "name"), ("first_name", "givenName"), ("middle_name", "additionalName"), ("last_name", "familyName"), ("bio", "description"), ("gender", "gender")):
        if own.get(key):
            out.append((s, _p(p), term(own[key]), g))
    if "@" in (own.get("email") or ""):
        node = f"<mailto:{own['email'].lower()}>"
        out += [(s, _p("email"), node, g), (node, TYPE, f"<{PERSONAL}EmailAddress>", g), (node, _p("name"), term(own["email"]), g)]
    if m := re.fullmatch(r"(\d{2})/(\d{2})(?:/(\d{4}))?", own.get("birthday") or ""):
        out.append((s, _p("birthDate"), term(f"{m[3]}-{m[1]}-{m[2]}", "date") if m[3] else term(f"--{m[1]}-{m[2]}", "gMonthDay"), g))
    for key, p in (("hometown", "birthPlace"), ("location", "homeLocation")):
        place = own.get(key) or {}
        if place.get("name"):
            node = f"<urn:social:{place['id']}>" if place.get("id") else name_id("place", place["name"])
            out += [(s, _p(p), node, g), (node, TYPE, _p("Place"), g), (node, _p("name"), term(place["name"]), g)]
    for url in (own.get("link"), *(own.get("website") or "").split()):
        if url and re.match(r"\w+:\S+$", url):
            out.append((s, _p("url"), f"<{url}>", g))
    picture = ((own.get("picture") or {}).get("data") or {}).get("url")
    if picture:
        out.append((s, _p("image"), f"<{picture}>", g))
    return out


def same_as(a: str, b: str, g: str) -> list[Quad]:
    return [(a, SAME_AS, b, g), (b, SAME_AS, a, g)]


#: Parsers by media type; plug-ins add theirs.
PARSERS: dict[str, Callable[[bytes, str], Iterable[Quad]]] = {"text/vcard": vcard_quads, "text/calendar": ical_quads, "message/rfc822": parse_email, "application/social+json": parse_social, "application/social-profile+json": parse_social_profile}
EXTENSIONS = {".vcf": "text/vcard", ".vcard": "text/vcard", ".ics": "text/calendar", ".eml": "message/rfc822", ".social.json": "application/social+json", ".profile.json": "application/social-profile+json"}

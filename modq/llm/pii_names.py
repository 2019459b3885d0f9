"""Invented people, places, numbers and carrier sentences for training the personal-information model.

Spans are known by construction: ``filled`` writes a sentence around generated values and says where they stand.  Names come from
two short lists and, mostly, from syllables, so that the model learns form and context and not a list.
"""

from __future__ import annotations

import re
import string

import numpy as np

# common names of several languages; invented ones from syllables are the larger part
GIVEN = (
    "Anna Peter Maria John Fatima Omar Chloe Lucas Ingrid Pavel Aisha Diego Carmen Hans Greta Yuki Mei Arjun Lakshmi Kwame Zanele Ivan Olga Sofia "
    "Mateo Elena Pierre Camille Jürgen Heike Seán Niamh Rhys Lars Astrid Giulia Marco José Lucía Thomas Emily Daniel Grace Samuel Ruth Noah Laila "
    "Karim Hassan Layla Bruno Nina Viktor Tara Felix Ida Otto Clara Hugo Alice Simon Faith Joy Frank Bill Pat May June April Summer Art Gene Robin"
).split()
FAMILY = (
    "Smith Müller García Dubois Kowalski Novák Rossi Silva Jensen Larsson Okafor Mensah Khan Haddad Nguyen Tanaka Kim Singh Patel Cohen O'Brien "
    "MacLeod Fischer Weber Lefèvre Moreau Fernández López Horvat Ivanova Petrov Schmidt Brown Baker Stone Hill Field Wood King Young Brooks Fox "
    "Marsh Bishop Carpenter Taylor Walker West Winter Price Long Short Reed Lane Park Bell Cross Day Best"
).split()
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Mme", "Mlle", "M", "Herr", "Frau", "Sr", "Sra", "Señor", "Señora", "Professor", "Doctor", "Sir", "Madame")
_ON = ("b c d f g h j k l m n p r s t v w z br cl cr dr fl gr kl pr sch sh st th tr ch kh gh sv vl").split()
_NU = ("a e i o u a e i o ai ei ie ou é ü ö á ó").split()
_CO = ("n r l s t m k nd rt ld ng nk st ck x th").split()
_GIVEN_END = ("a e o i in an el us ine ette ias iel ina is on ar en yn wan jit een ika ota").split()
_FAMILY_END = ("son sen er mann berg ski ová ez ano elli ieu eau ard ic enko ov aru ola ade than nathan meyer stein field ford ley wood worth moor ton vale craft stone ow ant os is u i a e").split()
_TYPES = ("St. Street Rd Road Ave Avenue Blvd Boulevard Lane Ln Close Crescent Drive Dr. Way Row Court Place Square Terrace Rise Hill Gardens Parade Walk Mews").split()
_TOWN_END = ("ton ville burg port ford mouth stead by heim brunn gate bridge field wick ham mere ley bourne").split()
_WORDS = ("north old green mill bridge stone river king church oak elm cedar market station harbour west high lake rose copper silver iron long hollow").split()
_DOMAIN_END = ("com org net example test de fr es co.uk io info edu eu invalid").split()
_MONTHS = ("January February March April May June July August September October November December").split()


class Maker:
    """Seeded values; every method returns a string."""

    def __init__(self, seed: int, given: tuple[str, ...] = (), family: tuple[str, ...] = ()) -> None:
        self.rng = np.random.default_rng(seed)
        self.given_list, self.family_list = (*GIVEN, *given), (*FAMILY, *family)
        self.known_given = given

    def one(self, xs):
        return xs[int(self.rng.integers(len(xs)))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def digits(self, n: int) -> str:
        return "".join(self.one(string.digits) for _ in range(n))

    def like(self, shape: str) -> str:
        """Another string of the same shape: digits for digits, letters for letters; a leading zero or plus stays."""
        out = []
        for i, c in enumerate(shape):
            out.append(c if i == 0 and c in "0+" else self.one("123456789" if i < 2 else string.digits) if c.isdigit() else self.one(string.ascii_uppercase if c.isupper() else string.ascii_lowercase) if c.isalpha() else c)
        return "".join(out)

    def syllables(self, n: int) -> str:
        if self.chance(0.35):
            return "".join(self.one("bcdfghjklmnprstvwyz") + self.one("aeiou") for _ in range(n + 1))
        return "".join(self.one(_ON) + self.one(_NU) + (self.one(_CO) if self.chance(0.3) else "") for _ in range(n))

    def given(self) -> str:
        r = self.rng.random()
        if r < 0.2 and self.known_given:
            return self.one(self.known_given)
        if r < 0.45:
            return self.one(self.given_list)
        return (self.syllables(int(self.rng.integers(1, 3))) + self.one(_GIVEN_END)).capitalize()

    def family(self) -> str:
        r = self.rng.random()
        if r < 0.3:
            return self.one(self.family_list)
        if r < 0.5:
            return self.syllables(2).capitalize()
        name = (self.syllables(int(self.rng.integers(1, 3))) + self.one(_FAMILY_END)).capitalize()
        if self.chance(0.07):
            name += "-" + self.syllables(2).capitalize()
        elif self.chance(0.05):
            name = self.one(("Mc", "O'", "de ", "van ", "von ", "El-", "Al-", "Ben ")) + name
        return name

    def initial(self) -> str:
        return self.one(string.ascii_uppercase) + "."

    def title(self) -> str:
        t = self.one(TITLES)
        return t + "." if t in ("Dr", "Prof", "Sr", "Sra", "M") and self.chance(0.9) or t in ("Mr", "Mrs", "Ms") and self.chance(0.4) else t

    def person_name(self) -> str:
        r, family = self.rng.random(), self.family()
        if r < 0.5:
            return f"{self.given()} {family}"
        if r < 0.6:
            return f"{self.given()} {self.initial()} {family}"
        if r < 0.72:
            return f"{self.initial()} {family}"
        if r < 0.86:
            return f"{self.title()} {self.given() + ' ' if self.chance(0.12) else ''}{family}"
        return f"{family}, {self.given()}"

    def handle(self) -> str:
        return "".join(self.one("bcdfghklmnprstvyz") + self.one("aeiou") for _ in range(int(self.rng.integers(3, 6)))) + (self.digits(2) if self.chance(0.2) else "")

    def email(self) -> str:
        r, g, f = self.rng.random(), self.given().lower(), self.family().lower().replace(" ", "").replace("'", "")
        local = (
            f"{g[0]}{f}" if r < 0.25 else f"{g}{self.one('._-+')}{f}" if r < 0.45 else f"{f}{self.one('._-')}{g[:1]}" if r < 0.6
            else f"{self.handle()}{self.digits(int(self.rng.integers(0, 4)))}" if r < 0.8 else f"{f}_{g}{self.digits(2)}" if r < 0.9 else f"{g}+{self.handle()[:4]}"
        )
        host = self.syllables(int(self.rng.integers(1, 3))) if self.chance(0.6) else self.one(_WORDS) + self.one(("mail", "post", "box", "net", "-nine", "-web"))
        parts = [host, self.one(_DOMAIN_END)] if self.chance(0.75) else [self.one(("post", "mail", "uni")), host, self.one(_DOMAIN_END)]
        r = self.rng.random()
        at, dot = ("@", ".") if r < 0.55 else self.one(((" @ ", "."), (" (at) ", " (dot) "), ("[at]", "."), (" AT ", " DOT "), (" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] ")))
        return local + at + dot.join(parts)

    _PHONES = (
        "+44 7700 900 123", "07700 900123", "00441632960123", "01632 960123", "020 7946 0123", "+1 555 555 0123", "(555) 555-0123", "555-0123", "555-555-0123", "1-555-555-0123",
        "+49-30-23125-123", "030/23125123", "+49 30 23125123", "01 99 00 12 34", "+33199001234", "+33 1 99 00 12 34", "+34 912 345 678", "912 345 678", "0171 2345678", "5555550123",
    )

    def phone(self) -> str:
        shape = self.like(self.one(self._PHONES))
        return shape if self.chance(0.85) else "+" + self.digits(2) + self.one((" ", "-", ".")) + self.one((" ", "-", ".")).join(self.digits(int(self.rng.integers(2, 4))) for _ in range(4))

    _IDS = (
        "ZX220589", "X4567729", "000-68-8168", "666 81 2687", "000579372", "061/395/97288", "74499942-W", "PETE177341Q9", "L50Q08927", "159197413A", "16-263110-0749",
        "C01X00T47", "123456789", "AB 12 34 56 C", "1 85 05 78 006 084 36", "99999999R", "X1234567L", "12345678Z", "P1234567", "D12-345-678",
    )

    def id_number(self) -> str:
        return self.like(self.one(self._IDS))

    def town(self) -> str:
        r = self.rng.random()
        name = (self.syllables(1) + self.one(_TOWN_END)).capitalize()
        return name if r < 0.6 else f"{name} {self.one(('Sands', 'Cross', 'Bay', 'Green', 'Heath', 'Vale', 'End'))}" if r < 0.8 else self.one(("Berlin", "Paris", "Madrid", "Leeds", "Boston", "Lyon", "Sevilla", "Hamburg", "Dublin", "Oslo"))

    def street_name(self) -> str:
        a = self.one(_WORDS).capitalize() if self.chance(0.4) else (self.syllables(1) + self.one(_FAMILY_END + _TOWN_END)).capitalize()
        return f"{a} {self.one(('Rise', 'Vale', 'Park', 'Mill'))}" if self.chance(0.15) else a

    def address(self) -> str:
        r, n = self.rng.random(), str(int(self.rng.integers(1, 300)))
        post = self.digits(5)
        town = "" if self.chance(0.3) else f", {self.town()}" if self.chance(0.6) else f", {self.town()} {post}"
        land = "" if self.chance(0.3) else f", {post} {self.town()}" if self.chance(0.6) else f", {self.town()}"
        if r < 0.4:
            flat = f"{self.one(('Flat', 'Apt.', 'Unit', 'Apartment', 'Suite'))} {int(self.rng.integers(1, 40))}, " if self.chance(0.3) else ""
            return f"{flat}{n}{self.one('abc') if self.chance(0.15) else ''} {self.street_name()} {self.one(_TYPES)}{town}"
        if r < 0.58:
            kind = self.one(("straße", "strasse", "gasse", "allee", "weg", "platz", "ufer", "str.", "ring", " Straße", " Weg"))
            return f"{(self.syllables(1) + self.one(('er', 'en', 'berg', 'mann', ''))).capitalize()}{kind} {n}{self.one('abc') if self.chance(0.1) else ''}{land}"
        if r < 0.72:
            name = " ".join((self.syllables(1) + self.one(('in', 'ier', 'ette', 'ois', 'e'))).capitalize() for _ in range(1 if self.chance(0.6) else 2))
            return f"{n}{',' if self.chance(0.6) else ''} {self.one(('rue', 'avenue', 'boulevard', 'place', 'chemin', 'quai', 'impasse'))} {self.one(('des ', 'de la ', 'du ', '', 'de '))}{name}{land}"
        if r < 0.86:
            name = " ".join((self.syllables(1) + self.one(('o', 'a', 'ero', 'al', 'os'))).capitalize() for _ in range(1 if self.chance(0.5) else 2))
            return f"{self.one(('calle', 'avenida', 'plaza', 'paseo', 'Calle', 'Avda.'))} {self.one(('', 'de ', 'del ', 'Del ', 'de la '))}{name} {n}{', ' + self.digits(1) + ' ' + self.one('ABC') if self.chance(0.4) else ''}{land}"
        box = self.one(("PO Box", "P.O. Box", "P. O. Box", "Postfach", "Apartado", "apartado de correos", "boîte postale", "BP", "B.P."))
        return f"{box} {self.digits(int(self.rng.integers(2, 5)))}{land if self.chance(0.5) else town}"

    def make(self, kind: str) -> str:
        return getattr(self, kind)()


# carrier sentences; the slot of each kind is written {kind}
CARRIERS = {
    "email": (
        "write to {}", "Mail: {}", "Contact {} for details.", "my address is {}, thanks", "({})", "send it to {} please", "{} is my inbox", "reach me under <{}>.", "e-mail {}!", "mailto:{}",
        "Escríbeme a {}", "écrivez à {}, merci", "Schreib an {}.", "From: {}", "cc {}; bcc nobody", "forwarded by {} yesterday", "the account {} was banned",
    ),
    "phone": (
        "call {}", "Tel. {}", "my number: {}", "ring {} after six", "the phone {} rang", "text {} now!", "WhatsApp {}", "fax {}", "phone {}, ask for me", "Appelez le {}.", "llama al {}", "Ruf {} an", "{} is my mobile", "reach us at {}.", "mobile: {};",
    ),
    "id_number": (
        "passport {}", "my passport number is {}", "SSN {}", "ssn: {}", "social security number {}", "tax id {}", "tax number: {}", "national ID {}", "driving licence {}", "driver's license no. {}", "licence number {}", "ID card {}", "identity card no. {}",
        "DNI {}", "NIE {}", "mi pasaporte es {}", "Ausweisnummer {}", "Reisepass Nr. {}", "Steuer-ID {}", "Führerschein {}", "passeport n° {}", "numéro de sécurité sociale {}", "permis de conduire {}", "carte d'identité {}", "número de la seguridad social {}", "his passport ({}) expired", "Personalausweis {}",
    ),
    "address": (
        "lives at {}", "I live at {}.", "deliver to {}", "Address: {}", "my house is {}, come by", "moved to {}", "send it to {}, please", "the party is at {}", "they found them at {}.", "vive en {}", "habite {}", "wohnt in der {}", "wohnt {}", "visit {} any time", "his home, {}, is empty", "post to {}!", "{} is where they live",
    ),
    "person_name": (
        "contact {}", "signed, {}", "Signed: {}", "mail {}", "Regards, {}", "Best, {}", "my boss {} said so", "{} wrote this", "thanks to {}", "ask {} about it", "{} lives next door", "It was {}!", "I saw {} there", "told by {} yesterday", "the teacher, {}, left", "according to {}, it rained",
        "Das war {}", "Lo dijo {}", "C'est {} qui l'a fait", "signé {}", "gezeichnet {}", "firmado: {}", "met {} on Monday", "{} and I agree", "with {} from work", "call {} tomorrow", "Name: {}", "patient {}", "our neighbour {}", "{}'s photo", "dear {},", "Hello {}!", "{} stole my bike", "is {} here?", "(photo: {})", "by {}", "cc: {}",
    ),
}


def decoy(m: Maker) -> str:
    """A sentence that looks like personal information and is none."""
    return m.one(
        (
            lambda: f"Ask {m.given()} about it.", lambda: f"{m.given()} and {m.given()} went home.", lambda: f"{m.given()} said so.", lambda: f"thanks to {m.handle()}", lambda: f"@{m.handle()} is right.",
            lambda: f"See {m.handle()} for details.", lambda: f"Order {m.digits(8)}-{m.digits(2)}-{m.digits(3)} is late.", lambda: f"Version {m.digits(1)}.{m.digits(1)}.{m.digits(3)} is broken.",
            lambda: f"posted on 20{m.digits(2)}-0{m.digits(1)}-1{m.digits(1)} 1{m.digits(1)}:2{m.digits(1)}:0{m.digits(1)}.", lambda: f"Room {m.digits(3)} on {m.street_name()} {m.one(_TYPES)} is cold.",
            lambda: f"{m.street_name()} {m.one(('Road', 'Street', 'Lane'))} closes in {m.one(_MONTHS)}.", lambda: f"{m.town()} {m.one(('United', 'Rovers', 'City', 'Bakery', 'Library', 'Choir'))} won again.",
            lambda: f"Flight {m.one('ABKL')}{m.one('XYZ')} {m.digits(3)} was late, gate {m.digits(2)}.", lambda: f"The petition has {m.digits(1)} {m.digits(3)} {m.digits(3)} views.", lambda: f"It costs {m.digits(4)}.{m.digits(2)} euros.",
            lambda: f"The {m.town()} festival starts on {m.digits(2)} {m.one(_MONTHS)} 20{m.digits(2)}.", lambda: f"in {m.town()} and {m.town()}", lambda: f"ticket #{m.digits(7)}", lambda: f"ISBN 978-{m.digits(1)}-{m.digits(4)}-{m.digits(4)}-{m.digits(1)}",
            lambda: f"{m.digits(3)} of {m.digits(4)} votes", lambda: f"Who owns the passport office?", lambda: f"the phone call at {m.digits(1)} pm", lambda: f"score {m.digits(2)}-{m.digits(2)}, row {m.digits(2)}", lambda: f"{m.family()} Street Market",
            lambda: f"The {m.one(_WORDS).capitalize()} {m.one(_WORDS).capitalize()} closed.", lambda: f"seats {m.digits(2)}-{m.digits(2)}-A and {m.digits(2)}-{m.digits(2)}-B", lambda: f"serial {m.like('AB12-99871')}", lambda: f"#{m.handle()}", lambda: f"part no. {m.like('4711-0815')}",
            lambda: f"It ended {m.digits(1)}-{m.digits(1)} after {m.digits(1)} @ {m.digits(1)} odds", lambda: f"the package {m.handle()}@{m.digits(1)}.{m.digits(1)}.{m.digits(1)} fails", lambda: f"a bank code {m.digits(3)}", lambda: f"Sorry {m.handle()}, but no.", lambda: f"the {m.family()} thread", lambda: f"{m.one(('Monday', 'Tuesday', 'Friday'))} {m.one(('Morning', 'Night'))} {m.one(('Club', 'Show'))}",
        )
    )()


def carrier(m: Maker, kind: str) -> tuple[str, tuple[int, int, str]]:
    """A sentence around a generated value of a kind, and where it stands."""
    before, after = m.one(CARRIERS[kind]).split("{}", 1)
    if m.chance(0.5):
        before = before[:1].upper() + before[1:]
    value = m.make(kind)
    return before + value + after, (len(before), len(before) + len(value), kind)


_BREAK = re.compile(r"(?<=[.!?]) ")


def sentences(text: str) -> list[str]:
    return _BREAK.split(text)


def inserted(m: Maker, text: str, spans: list[tuple[int, int, str]], piece: str, own: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """A text with a sentence put between two of its own, and all spans."""
    places = [0, *(b.end() for b in _BREAK.finditer(text) if all(not (a < b.end() < e) for a, e, _ in spans))]
    at = m.one(places)
    end = m.one((". ", " ", "! ", "; ", ", ")) if not piece.endswith((".", "!", ";", "?")) else " "
    whole = piece + end
    moved = [(a, b, k) if b <= at else (a + len(whole), b + len(whole), k) for a, b, k in spans]
    return text[:at] + whole + text[at:], sorted([*moved, *((a + at, b + at, k) for a, b, k in own)])


_SOMEBODY = re.compile(
    r"\b(?:[Tt]he|[Oo]ur|[Mm]y|[Ss]ome|[Aa]n?|[Tt]his|[Tt]hat|[Ee]very|[Ll][ae]|[Ee]l|[Uu]n[ae]?|[Dd]er|[Dd]ie|[Ee]ine?|[Mm]eine?|[Ii]t|[Tt]hey|[Ss]omebody|[Nn]obody|[Aa]nyone|[Yy]ou)\b(?: [A-Za-zà-ÿÀ-Þ]+)?"
)


def named(m: Maker, text: str, most: int = 2) -> tuple[str, list[tuple[int, int, str]]]:
    """A text in which a name stands for a person or thing it speaks of: names occur in any context, not only in carriers."""
    places = [p.span() for p in _SOMEBODY.finditer(text)]
    if not places:
        return text, []
    m.rng.shuffle(places)
    return refilled(m, text, sorted((int(a), int(b), "person_name") for a, b in places[: 1 + m.chance(0.5) * (most - 1)]), 1.0, like_old=False)


def refilled(m: Maker, text: str, spans: list[tuple[int, int, str]], p: float, like_old: bool = True) -> tuple[str, list[tuple[int, int, str]]]:
    """A text whose spans hold other values of their kinds, in the case of the old ones."""
    out, done, last, size = [], [], 0, 0
    for a, b, kind in spans:
        old = text[a:b]
        if m.chance(p):
            new = m.like(old) if kind in ("phone", "id_number") and m.chance(0.5) else m.make(kind)
            if like_old and kind not in ("phone", "id_number"):
                new = new.upper() if old.isupper() else new.lower() if old.islower() else new
        else:
            new = old
        out += [text[last:a], new]
        size += a - last
        done.append((size, size + len(new), kind))
        size, last = size + len(new), b
    return "".join([*out, text[last:]]), done

"""Providers of other locales: names, streets, cities, postal codes and phone numbers as they are written there.

A locale's provider has the names and the index arithmetic of the default one; a kind that a locale has no words for is that of the
default locale.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidRule
from ..keys import int_div

DEFAULT = "en_US"


@dataclass(frozen=True)
class Words:
    first: tuple[str, ...]
    last: tuple[str, ...]
    streets: tuple[str, ...]
    cities: tuple[str, ...]    # city, first digits of its postal code
    street_form: str           # {n} the number, {s} the street
    postal_digits: int
    phone: str                 # each # is a digit of the index
    name_form: str = "{f} {l}"


# Word lists and forms of writing of each locale, our own.
LOCALES: dict[str, Words] = {
    "de_DE": Words(("Anna", "Ben", "Clara", "David", "Elias", "Frieda", "Greta", "Hannah", "Jonas", "Käthe", "Lukas", "Maximilian", "Paul", "Sophie", "Jörg", "Ulrike"),
                   ("Müller", "Schmidt", "Schneider", "Fischer", "Weber", "Meyer", "Wagner", "Becker", "Schulz", "Hoffmann", "Schäfer", "Koch", "Bauer", "Richter", "Klein", "Weiß"),
                   ("Hauptstraße", "Bahnhofstraße", "Gartenweg", "Lindenallee", "Schulstraße", "Bergstraße", "Am Markt", "Dorfstraße"),
                   ("Berlin,10", "Hamburg,20", "München,80", "Köln,50", "Leipzig,04", "Stuttgart,70", "Dresden,01", "Bremen,28"), "{s} {n}", 5, "+49 30 ### ####"),
    "fr_FR": Words(("Camille", "Louis", "Chloé", "Hugo", "Léa", "Gabriel", "Manon", "Jules", "Inès", "Arthur", "Zoé", "Raphaël", "Élise", "Théo", "Noémie", "François"),
                   ("Martin", "Bernard", "Dubois", "Thomas", "Robert", "Richard", "Petit", "Durand", "Leroy", "Moreau", "Simon", "Laurent", "Lefèvre", "Michel", "Garcia", "Roux"),
                   ("rue de la Paix", "avenue Victor Hugo", "rue des Écoles", "place du Marché", "chemin du Moulin", "rue Pasteur", "boulevard Voltaire", "rue du Château"),
                   ("Paris,75", "Lyon,69", "Marseille,13", "Toulouse,31", "Nantes,44", "Lille,59", "Bordeaux,33", "Rennes,35"), "{n} {s}", 5, "+33 1 99 00 ## ##"),
    "es_ES": Words(("Lucía", "Hugo", "María", "Martín", "Sofía", "Pablo", "Carmen", "Álvaro", "Elena", "Javier", "Nuria", "Íñigo", "Ana", "Diego", "Raquel", "Jesús"),
                   ("García", "Fernández", "González", "Rodríguez", "López", "Martínez", "Sánchez", "Pérez", "Gómez", "Ruiz", "Díaz", "Muñoz", "Álvarez", "Romero", "Navarro", "Ibáñez"),
                   ("Calle Mayor", "Calle Real", "Avenida de la Constitución", "Plaza de España", "Calle del Sol", "Paseo del Prado", "Calle Nueva", "Ronda Norte"),
                   ("Madrid,28", "Barcelona,08", "Valencia,46", "Sevilla,41", "Zaragoza,50", "Málaga,29", "Bilbao,48", "Murcia,30"), "{s}, {n}", 5, "+34 910 ### ###"),
    "ja_JP": Words(("蓮", "陽菜", "大翔", "結衣", "颯太", "葵", "悠真", "凛", "健", "美咲", "翔太", "さくら"),
                   ("佐藤", "鈴木", "高橋", "田中", "伊藤", "渡辺", "山本", "中村", "小林", "加藤", "吉田", "山田"),
                   ("本町", "中央", "栄町", "緑町", "桜台", "東"), ("東京,100", "大阪,530", "名古屋,450", "札幌,060", "福岡,810", "仙台,980"), "{s}{n}", 7, "+81 3 #### ####", "{l} {f}"),
}
MOST_NUMBER = 199  # of a house


def _item(words: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (i % len(words) + 1).cast("int"))


def _filled(form: str, parts: dict[str, Column]) -> Column:
    """A form of writing with its parts in place."""
    out, rest = [], form
    while "{" in rest:
        before, _, rest = rest.partition("{")
        key, _, rest = rest.partition("}")
        out += [F.lit(before), parts[key]]
    return F.concat(*out, F.lit(rest))


def _digits(form: str, i: Column) -> Column:
    """Every # is a digit of the index, the last one its ones."""
    places, out = form.count("#"), []
    for ch in form:
        if ch == "#":
            places -= 1
            out.append((int_div(i, 10**places) % 10).cast("string"))
        else:
            out.append(F.lit(ch))
    return F.concat(*out)


def localized(locale: str) -> dict[str, tuple[int, Callable[[Column], Column]]]:
    """provider -> (size, column function of an index) of one locale."""
    if locale not in LOCALES:
        raise InvalidRule(f"unknown locale {locale!r}")
    w = LOCALES[locale]
    names, towns = len(w.first) * len(w.last), len(w.cities)
    inner = w.postal_digits - len(w.cities[0].split(",")[1])
    name = lambda i: _filled(w.name_form, {"f": _item(w.first, i), "l": _item(w.last, int_div(i, len(w.first)))})
    town = lambda i, part: F.split(_item(w.cities, i), ",")[part]
    street = lambda i: _filled(w.street_form, {"s": _item(w.streets, i), "n": (int_div(i, len(w.streets)) % MOST_NUMBER + 1).cast("string")})
    code = lambda i: F.concat(town(i, 1), F.lpad((int_div(i, towns) % 10**inner).cast("string"), inner, "0"))
    whole = lambda i: F.concat(street(int_div(i, towns * 10**inner)), F.lit(", "), code(i), F.lit(" "), town(i, 0))
    streets = len(w.streets) * MOST_NUMBER
    return {
        "person_first_name": (len(w.first), lambda i: _item(w.first, i)), "person_last_name": (len(w.last), lambda i: _item(w.last, i)),
        "person_name": (names, name), "person_full_name": (names, name), "person_phone": (10 ** w.phone.count("#"), lambda i: _digits(w.phone, i)),
        "address_street": (streets, street), "address_city": (towns, lambda i: town(i, 0)), "address_zip": (towns * 10**inner, code),
        "address_full": (towns * 10**inner * streets, whole),
    }

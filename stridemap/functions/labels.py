"""Texts of itineraries: modes, templates, languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stridemap.functions.clock import format_clock, whole_minutes


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def fill(template: Column, **values: Column) -> Column:
    """Put values for {name}; other placeholders stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


#: Texts of itineraries by language.
TEXTS = {
    "en": {
        "journey.alreadyHere": "You are already here.",
        "journey.summary": "Arrive {time} · {minutes} min",
        "journey.change.one": " · {count} change",
        "journey.change.other": " · {count} changes",
        "journey.from": "From {name}",
        "journey.walk": "Walk {duration} to {name}",
        "journey.wait": "Wait {duration}",
        "journey.ride": "{mode} {departure} → {arrival} to {name}",
        "journey.minutes": "{count} min",
        "mode.rail": "Rail",
        "mode.bus": "Bus",
        "mode.tram": "Tram",
        "mode.metro": "Metro",
        "mode.ferry": "Ferry",
        "mode.cableCar": "Cable car",
        "mode.funicular": "Funicular",
        "mode.transit": "Transit",
    },
    "fr": {
        "journey.alreadyHere": "Vous êtes déjà ici.",
        "journey.summary": "Arrivée {time} · {minutes} min",
        "journey.change.one": " · {count} changement",
        "journey.change.other": " · {count} changements",
        "journey.from": "Depuis {name}",
        "journey.walk": "Marchez {duration} jusqu'à {name}",
        "journey.wait": "Attente {duration}",
        "journey.ride": "{mode} {departure} → {arrival} jusqu'à {name}",
        "journey.minutes": "{count} min",
        "mode.rail": "Train",
        "mode.bus": "Bus",
        "mode.tram": "Tram",
        "mode.metro": "Métro",
        "mode.ferry": "Bateau",
        "mode.cableCar": "Téléphérique",
        "mode.funicular": "Funiculaire",
        "mode.transit": "Transport",
    },
    "de": {
        "journey.alreadyHere": "Sie sind bereits hier.",
        "journey.summary": "Ankunft {time} · {minutes} Min",
        "journey.change.one": " · {count} Umstieg",
        "journey.change.other": " · {count} Umstiege",
        "journey.from": "Ab {name}",
        "journey.walk": "{duration} zu Fuss bis {name}",
        "journey.wait": "{duration} Wartezeit",
        "journey.ride": "{mode} {departure} → {arrival} bis {name}",
        "journey.minutes": "{count} Min",
        "mode.rail": "Bahn",
        "mode.bus": "Bus",
        "mode.tram": "Tram",
        "mode.metro": "Metro",
        "mode.ferry": "Schiff",
        "mode.cableCar": "Seilbahn",
        "mode.funicular": "Standseilbahn",
        "mode.transit": "ÖV",
    },
}

#: Route type -> (text, colour of its dot).
MODES = {
    0: ("mode.tram", "#2980b9"),
    1: ("mode.metro", "#2980b9"),
    2: ("mode.rail", "#c0392b"),
    3: ("mode.bus", "#e67e22"),
    4: ("mode.ferry", "#16a085"),
    5: ("mode.cableCar", "#8e44ad"),
    6: ("mode.cableCar", "#8e44ad"),
    7: ("mode.funicular", "#8e44ad"),
}
OTHER_MODE = ("mode.transit", "#555555")
WALK_COLOUR = "#999999"


def mode_label(mode: Column, language: str) -> Column:
    out = F.lit(TEXTS[language][OTHER_MODE[0]])
    for number, (key, _) in MODES.items():
        out = F.when(mode == number, TEXTS[language][key]).otherwise(out)
    return out


def mode_colour(mode: Column) -> Column:
    out = F.lit(OTHER_MODE[1])
    for number, (_, colour) in MODES.items():
        out = F.when(mode == number, colour).otherwise(out)
    return out


def duration_text(seconds: Column, language: str) -> Column:
    return fill(F.lit(TEXTS[language]["journey.minutes"]), count=whole_minutes(seconds))


def change_text(count: Column, language: str) -> Column:
    texts = TEXTS[language]
    return F.when(count <= 0, F.lit("")).when(count == 1, fill(F.lit(texts["journey.change.one"]), count=count)).otherwise(fill(F.lit(texts["journey.change.other"]), count=count))


def segment_html(colour: Column, text: Column) -> Column:
    return F.concat(F.lit('<div class="segment"><span class="mode-dot" style="background:'), colour, F.lit('"></span><span class="text">'), text, F.lit("</span></div>"))


def ride_text(mode: Column, dep: Column, arr: Column, name: Column, language: str) -> Column:
    return fill(F.lit(TEXTS[language]["journey.ride"]), mode=mode_label(mode, language), departure=format_clock(dep), arrival=format_clock(arr), name=name)


def walk_text(dep: Column, arr: Column, name: Column, language: str) -> Column:
    return fill(F.lit(TEXTS[language]["journey.walk"]), duration=duration_text(arr - dep, language), name=name)

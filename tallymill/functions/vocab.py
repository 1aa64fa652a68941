"""Fixed values shared by extraction and scoring: number words, synonyms, days, units, keyword lists."""

from __future__ import annotations

# Spelled-out numbers.
NUMBER_WORDS = {
    "zero": 0, "no": 0, "none": 0,
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5,
    "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14,
    "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20,
}

# Yes and no words in six languages.
YES_WORDS = (
    "yes", "true", "correct", "right", "si", "sí", "oui", "ja",
    "是", "对", "так", "правда", "verdadero", "vrai", "richtig",
)
NO_WORDS = (
    "no", "false", "incorrect", "wrong", "non", "nein",
    "不", "否", "错", "ні", "неправда", "falso", "faux", "falsch",
)
# Texts a scorer takes as true or false.
TRUE_TEXTS = ("true", "yes", "1", "correct", "right")
FALSE_TEXTS = ("false", "no", "0", "incorrect", "wrong")

# Location names that mean the same place.
LOCATION_SYNONYMS = {
    "counter": ("counter", "countertop", "kitchen counter", "worktop", "benchtop", "work surface"),
    "table": ("table", "tabletop", "dining table", "kitchen table", "coffee table"),
    "shelf": ("shelf", "bookshelf", "shelving", "cupboard shelf"),
    "desk": ("desk", "desktop", "writing desk", "work desk"),
    "microwave": ("microwave", "microwave oven"),
    "refrigerator": ("refrigerator", "fridge", "icebox"),
    "oven": ("oven", "stove"),
    "floor": ("floor", "ground", "flooring"),
    "sink": ("sink", "basin"),
    "drawer": ("drawer",),
    "cabinet": ("cabinet", "cupboard"),
    "dresser": ("dresser", "bureau", "chest of drawers"),
    "nightstand": ("nightstand", "bedside table", "night table"),
}
# Container names that mean the same container.
CONTAINER_SYNONYMS = {
    "basket": ("basket", "hamper", "wicker basket"),
    "box": ("box", "container", "storage box", "carton"),
    "drawer": ("drawer", "cabinet drawer"),
    "cupboard": ("cupboard", "cabinet", "closet"),
    "bag": ("bag", "purse", "sack", "tote"),
    "pocket": ("pocket", "coat pocket", "pants pocket"),
}

# Day names in six languages.
DAY_NAMES = {
    "Monday": ("monday", "mon", "lunes", "lundi", "montag", "понеділок", "星期一", "周一"),
    "Tuesday": ("tuesday", "tue", "tues", "martes", "mardi", "dienstag", "вівторок", "星期二", "周二"),
    "Wednesday": ("wednesday", "wed", "miércoles", "mercredi", "mittwoch", "середа", "星期三", "周三"),
    "Thursday": ("thursday", "thu", "thur", "thurs", "jueves", "jeudi", "donnerstag", "четвер", "星期四", "周四"),
    "Friday": ("friday", "fri", "viernes", "vendredi", "freitag", "п'ятниця", "星期五", "周五"),
    "Saturday": ("saturday", "sat", "sábado", "samedi", "samstag", "субота", "星期六", "周六"),
    "Sunday": ("sunday", "sun", "domingo", "dimanche", "sonntag", "неділя", "星期日", "周日"),
}

# Answers that say two quantities are equal, and phrases that say they cannot be compared.
EQUAL_ANSWERS = (
    "equal", "same", "equivalent", "they are equal", "both are equal", "equal value", "they're equal",
    "igual", "iguales", "égal", "gleich", "相等", "相同", "рівні",
)
INCOMPARABLE_PHRASES = (
    "incomparable", "cannot compare", "can't compare", "not comparable",
    "different dimensions", "different categories", "impossible to compare",
    "cannot be compared", "can't be compared", "no se puede comparar", "no se pueden comparar",
    "nicht vergleichbar", "无法比较", "不能比较", "不可比较", "непорівнянні", "неможливо порівняти",
)

# Unit symbol -> (category, factor to the base unit, ways to write it).
# Temperatures convert by an affine rule and carry no factor.
UNITS = {
    "mm": ("length", 0.001, ("mm", "millimeter", "millimeters", "millimetre", "millimetres")),
    "cm": ("length", 0.01, ("cm", "centimeter", "centimeters", "centimetre", "centimetres")),
    "m": ("length", 1.0, ("m", "meter", "meters", "metre", "metres")),
    "km": ("length", 1000.0, ("km", "kilometer", "kilometers", "kilometre", "kilometres")),
    "in": ("length", 0.0254, ("in", "inch", "inches", '"')),
    "ft": ("length", 0.3048, ("ft", "foot", "feet", "'")),
    "yd": ("length", 0.9144, ("yd", "yard", "yards")),
    "mi": ("length", 1609.344, ("mi", "mile", "miles")),
    "mg": ("mass", 0.001, ("mg", "milligram", "milligrams")),
    "g": ("mass", 1.0, ("g", "gram", "grams")),
    "kg": ("mass", 1000.0, ("kg", "kilogram", "kilograms")),
    "oz": ("mass", 28.3495, ("oz", "ounce", "ounces")),
    "lb": ("mass", 453.592, ("lb", "lbs", "pound", "pounds")),
    "°C": ("temperature", None, ("°c", "celsius", "c", "degrees celsius", "deg c")),
    "°F": ("temperature", None, ("°f", "fahrenheit", "f", "degrees fahrenheit", "deg f")),
    "K": ("temperature", None, ("k", "kelvin")),
    "mL": ("volume", 1.0, ("ml", "milliliter", "milliliters", "millilitre", "millilitres")),
    "L": ("volume", 1000.0, ("l", "liter", "liters", "litre", "litres")),
    "cup": ("volume", 236.588, ("cup", "cups")),
    "fl oz": ("volume", 29.5735, ("fl oz", "fluid ounce", "fluid ounces", "fl. oz", "fl.oz")),
    "pt": ("volume", 473.176, ("pt", "pint", "pints")),
    "gal": ("volume", 3785.41, ("gal", "gallon", "gallons")),
    "m/s": ("speed", 1.0, ("m/s", "meters per second", "metres per second")),
    "km/h": ("speed", 1.0 / 3.6, ("km/h", "kmh", "kph", "kilometers per hour", "kilometres per hour")),
    "mph": ("speed", 0.44704, ("mph", "miles per hour")),
    "s": ("time", 1.0, ("s", "sec", "second", "seconds")),
    "min": ("time", 60.0, ("min", "minute", "minutes")),
    "h": ("time", 3600.0, ("h", "hr", "hour", "hours")),
}

# International Morse code.
MORSE = {
    "A": ".-", "B": "-...", "C": "-.-.", "D": "-..", "E": ".", "F": "..-.", "G": "--.", "H": "....",
    "I": "..", "J": ".---", "K": "-.-", "L": ".-..", "M": "--", "N": "-.", "O": "---", "P": ".--.",
    "Q": "--.-", "R": ".-.", "S": "...", "T": "-", "U": "..-", "V": "...-", "W": ".--", "X": "-..-",
    "Y": "-.--", "Z": "--..",
    "0": "-----", "1": ".----", "2": "..---", "3": "...--", "4": "....-",
    "5": ".....", "6": "-....", "7": "--...", "8": "---..", "9": "----.",
}

# Relative model size per quantization.
COMPRESSION = {"F16": 1.0, "Q8_0": 0.5, "Q4_K_M": 0.25, "Q2_K": 0.125}


def inverted(groups: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Each variant with its canonical name; the first group to name a variant keeps it."""
    out: dict[str, str] = {}
    for canonical, variants in groups.items():
        for variant in variants:
            out.setdefault(variant.lower(), canonical)
    return out

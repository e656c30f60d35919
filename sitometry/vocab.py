"""Vocabulary profiles: stems, patterns, strengths and conversion factors as plain parameters.

Text is matched after normalisation (no accents, case folded). A word character is spelt out as a
class of letters, digits and the underscore, since the engine's own ``\\w`` is ASCII.
"""

from __future__ import annotations

from dataclasses import dataclass, field

W = r"[\p{L}\p{N}_]"
NOT_AFTER, NOT_BEFORE = rf"(?<!{W})", rf"(?!{W})"


def stems(words: str) -> str:
    """A pattern for whole words that begin with one of the given stems; group 1 is the stem.

    That no word character stands before the stem is looked up only where the letters of the stem are found.
    """
    known = [f"{s}(?<!{W}{s})" if s.isalpha() else f"{NOT_AFTER}{s}" for s in words.split()]
    return f"({'|'.join(known)}){W}*"


@dataclass(frozen=True)
class Profile:
    grain: str
    unit: str
    money: str
    priceword: str
    false_grain: str
    admin_compound: str
    near_admin: str
    boundary: str
    blocked_form: str
    numeral: str
    unit_core: str
    money_core: str
    weakener: str
    negative: dict[str, str] = field(default_factory=dict)
    positive: dict[str, tuple[str, float]] = field(default_factory=dict)
    grains: tuple[tuple[str, str], ...] = ()
    units: tuple[tuple[str, str], ...] = ()
    currencies: tuple[tuple[str, str], ...] = ()
    places: tuple[tuple[str, str], ...] = ()


# Conversion factors to the drachma and to litres.
DRACHMA = {"drachma": 1.0, "obol": 1.0 / 6.0, "chalkous": 1.0 / 48.0, "denarius": 4.0, "sestertius": 1.0, "mina": 100.0, "talent": 6000.0}
LITRE = {"artaba": 38.8, "choenix": 1.08, "medimnos": 52.5, "kotyle": 0.27, "metretes": 39.0}

# The Greek word stems, evidence classes in their order of precedence, and strengths.
GREEK = Profile(
    grain=stems("σιτ πυρ κριθ ζεα ολυρ σταχυ αλευρ"),
    unit=stems("αρταβ μεδιμν χοινι μετρ κοτυλ χοινιξ γομφ καλαθ"),
    money=stems("δραχμ οβολ δηναρ μνα ταλαντ σεστ ἀσσ χαλκ"),
    priceword=r"(τιμη|τιμ(?=[\.\)\(]))",
    false_grain=stems("σιτολογ σιτομετρ σιταρχ σιτοφορ σιτοποι σιτικ σιτηγ σιτηρεσ σιτωνι πυρρ πυριν"),
    admin_compound=stems("σιτολογ σιτομετρ σιτοσπορ σιτοποι"),
    near_admin=stems("φυλακιτικ παραναυλ αλεστρ χωματικ πρακτορ"),
    boundary=stems("γινονται λοιπ ομοιως"),
    blocked_form=rf"^κριθ(εν|εντ{W}*|εις|εισ{W}+|ηναι|ητω|ωσ{W}*|ησαν)$",
    numeral=rf"{NOT_AFTER}([α-ωϛϝϟϡ]{{1,6}}ʹ){NOT_BEFORE}",
    unit_core=rf"(?:(?:αρταβ|μεδιμν|χοιν|μετρ|κοτυλ|χοινιξ){W}*)",
    money_core=rf"(?:(?:δραχμ|οβολ|δηναρ|μνα|ταλαντ|σεστ|ἀσσ|χαλκ){W}*)",
    weakener=stems("αρουρ"),
    negative={
        "TAX": stems("φυλακιτικ χωματικ δημοσι εκφορ φορολογ διοικησ προσοδ λαογραφ μερισμ επιβολ"),
        "ADMIN": stems(rf"πρακτορ στρατηγ βασιλικ{W}*γραμματ κωμογραμματ θησαυροφυλακ γεωμετρ"),
        "TRANSPORT": stems("ναυλ φορετρ αλεστρ παραναυλ κοσκινευτ κατεργ"),
        "RATION": stems("οψων σιτηρεσ διατροφ επισιτισμ"),
        "LOAN": stems("ατοκ δανε εντοκ τοκος"),
        "SEED": stems("σπερμ σπειρ σπορα σπορο σπορι"),
    },
    positive={
        "receipt_price": (rf"(απο\s+τιμ|εις\s+τιμ|υπερ\s+τιμ|εκ\s+τιμ){W}*", 0.7),
        "rate_construction": (rf"(ως\s+της\s+αρταβης|ανα\s+δραχμ{W}*|εκ\s+δραχμ{W}*|ανα\s+αρταβ{W}*|εκαστης\s+{W}*\s*δραχμ{W}*)", 0.8),
        "priceword_ext": (stems("τιμη τιμης τιμην τιμας τιμαι τιμων"), 0.6),
        "sale_verb": (stems("αγοραζ ηγορακ επριατ ωνε πωλ πιπρασκ πεπρακ πρια ονησ"), 0.5),
    },
    grains=(("πυρ", "wheat (pyros)"), ("σιτ", "grain (sitos)"), ("κριθ", "barley (krithē)"), ("ζε", "spelt/zea"), ("ολυρ", "emmer (olyra)"), ("αλευρ", "flour (aleuron)"), ("σταχυ", "ear/spike (stachys)")),
    units=(("αρταβ", "artaba"), ("μεδιμν", "medimnos"), ("χοιν", "choenix"), ("κοτυλ", "kotyle"), ("μετρ", "metretes")),
    currencies=(("δραχ", "drachma"), ("οβολ", "obol"), ("δηναρ", "denarius"), ("μνα", "mina"), ("ταλαν", "talent"), ("σεστ", "sestertius"), ("χαλκ", "chalkous"), ("ασσ", "as")),
    places=(("oxyrh|οξυρ", "Oxyrhynchite"), ("arsin|αρσιν|φαγιουμ|fayum", "Arsinoite"), ("hermop|ερμοπ", "Hermopolite"), ("herakleop|ηρακλεοπ", "Herakleopolite"), ("memph|μεμφ", "Memphite"), ("panop|πανοπ|akhmim", "Panopolite"), ("theb|θηβ|λυκοπ|lycop", "Thebaid"), ("alex|αλεξανδρ", "Alexandria")),
)

# A profile for the driver's invented prose: its common syllables stand for the word classes.
PROSE = Profile(
    grain=stems("erin tion"),
    unit=stems("inge onth"),
    money=stems("andr thes"),
    priceword=r"(thehe|ingre)",
    false_grain=stems("tionth erinth"),
    admin_compound=stems("tionre"),
    near_admin=stems("anreth"),
    boundary=stems("reth thwh"),
    blocked_form=r"^tioned$",
    numeral=rf"{NOT_AFTER}([ivx]{{2,6}}){NOT_BEFORE}",
    unit_core=rf"(?:(?:inge|onth){W}*)",
    money_core=rf"(?:(?:andr|thes){W}*)",
    weakener=stems("ouan"),
    negative={"TAX": stems("edth edan"), "LOAN": stems("lyed")},
    positive={"receipt_price": (rf"(of\s+th){W}*", 0.7), "sale_verb": (stems("hand hare"), 0.5)},
)

"""Lexicons of the registered queries over the synthetic Latin tables."""

from ..functions.text import Lexicon

IMAGES = Lexicon((
    ("moon", ("thanea", "anea", "eaupa")), ("river", ("ering", "erin", "rivière")), ("stone", ("heit", "keiten", "keit")),
    ("light", ("eaux", "eau")), ("road", ("mente", "ment")), ("garden", ("jardín", "ción")),
))
FEELINGS = Lexicon((("joy", ("elle", "heed")), ("sorrow", ("schen", "ndea")), ("longing", ("queque", "thest")), ("rest", ("onan", "osta"))))
THEMES = Lexicon((("travel", ("tionre", "ungver")), ("autumn", ("oredat", "einheit")), ("home", ("delaa", "lesque"))))
LEXICONS = {"image": IMAGES, "feeling": FEELINGS, "theme": THEMES}
NEGATION = "(?:nicht|not|non|ne|no) ?.{0,2}$"

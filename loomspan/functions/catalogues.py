"""Small fixed dimensions (fixed values, stated as text)."""

YARN_WEIGHTS = ("lace", "fingering", "sport", "dk", "worsted", "aran", "bulky", "superbulky")
STATUSES = ("waiting", "wip", "pause", "done", "future", "abandoned")
TECHNIQUES = ("knitting", "crochet")
CURRENCIES = ("EUR", "USD", "GBP", "CHF", "CAD")
PATTERN_CATEGORIES = ("clothing", "accessories", "socks", "home", "amigurumi", "toys", "leisure", "animals", "other")
LABELS = ("vegan", "recyclee", "ethique", "sans-mulesing", "oeko-tex", "gots", "rws", "grs")
COMPOSITIONS = ("laine", "coton", "acrylique", "alpaga", "mohair", "soie", "lin", "bambou", "cachemire", "polyamide", "viscose")
#: Keyword of a lower-case weight text and the class it means; the first that occurs counts.
WEIGHT_KEYWORDS = [
    ("super bulky", "superbulky"), ("jumbo", "superbulky"), ("bulky", "bulky"), ("aran", "aran"), ("worsted", "worsted"),
    ("dk", "dk"), ("sport", "sport"), ("fingering", "fingering"), ("lace", "lace"), ("cobweb", "lace"),
]
#: Header of an import sheet (folded) and the field it fills.
HEADERS = {
    "status": "status", "brand": "brand", "yarn": "model", "colorway": "color", "color family": "color_family", "color attributes": "color_attributes", "weight": "weight",
    "grams/skein": "grams", "yards/skein": "yards", "meters/skein": "metres", "skeins": "quantity", "remaining skeins": "remaining", "dye lot": "lot", "stored in": "stored_in",
    "purchase date": "date", "price paid": "total_price", "purchased at": "store", "comments": "notes", "tag list": "tags",
}
IGNORED_HEADERS = ("total yards", "total meters", "total grams", "remaining yards", "remaining meters", "remaining grams", "has photo")
IMPORT_STATUSES = ("in stash", "all used up", "will trade or sell", "traded, sold, gifted")
#: Needle sizes: millimetres, US and UK numbers.
KNITTING_SIZES = [
    (0.5, "8/0", None), (0.75, "6/0", None), (1.0, "5/0", None), (1.25, "4/0", None), (1.5, "000", None), (1.75, "00", None), (2.0, "0", "14"), (2.25, "1", "13"), (2.5, "1½", None), (2.75, "2", "12"),
    (3.0, "2½", "11"), (3.25, "3", "10"), (3.5, "4", None), (3.75, "5", "9"), (4.0, "6", "8"), (4.5, "7", "7"), (5.0, "8", "6"), (5.5, "9", "5"), (6.0, "10", "4"), (6.5, "10½", "3"), (7.0, "10¾", "2"),
    (7.5, None, "1"), (8.0, "11", "0"), (9.0, "13", "00"), (10.0, "15", "000"), (12.0, "17", None), (15.0, "19", None), (19.0, "35", None), (25.0, "50", None),
]
#: Sizes the gauge recommendation chooses from.
RECOMMENDED_MM = {
    "knitting": [2.0, 2.25, 2.5, 2.75, 3.0, 3.25, 3.5, 3.75, 4.0, 4.5, 5.0, 5.5, 6.0, 6.5, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0],
    "crochet": [2.25, 2.75, 3.25, 3.5, 3.75, 4.0, 4.5, 5.0, 5.5, 6.0, 6.5, 8.0, 9.0, 10.0, 12.0, 15.0, 19.0],
}
#: Category of each tool type (inventory G15).
TOOL_TYPES = {
    "straight": "needle", "circular": "needle", "dpn": "needle", "flexible": "needle", "tips": "needle", "cable": "needle", "other": "needle",
    "interchangeable": "kit", "hookKit": "kit", "standard": "hook", "tunisian": "hook",
}
#: Whether a tool type has a size of its own, may have one, has none, or is a kit of sizes; which have a tunisian mark.
TOOL_SIZES = {
    "straight": "required", "circular": "required", "dpn": "required", "tips": "required", "flexible": "required", "cable": "none", "other": "optional",
    "interchangeable": "kit", "hookKit": "kit", "standard": "required", "tunisian": "required",
}
TUNISIAN_TYPES = ("hookKit", "tunisian")
#: Colours that can be chosen: name, hue, saturation, lightness.
PALETTE = (
    ("noir", 0, 0, 17), ("gris", 220, 6, 62), ("anthracite", 220, 8, 32), ("blanc", 40, 28, 92), ("ecru", 38, 38, 86), ("beige", 38, 30, 76),
    ("taupe", 30, 12, 58), ("camel", 33, 45, 58), ("marron", 25, 40, 34), ("chocolat", 22, 38, 28), ("rouge", 4, 65, 49), ("bordeaux", 348, 55, 32),
    ("rose", 340, 60, 75), ("fuchsia", 320, 70, 58), ("corail", 12, 72, 67), ("orange", 28, 78, 57), ("moutarde", 44, 70, 47), ("jaune", 50, 78, 62),
    ("vert", 135, 35, 46), ("sauge", 110, 18, 60), ("kaki", 70, 28, 42), ("emeraude", 160, 45, 40), ("turquoise", 180, 45, 46), ("bleu", 212, 55, 52),
    ("marine", 222, 45, 28), ("ciel", 205, 60, 72), ("lavande", 265, 40, 72), ("violet", 285, 40, 45), ("prune", 300, 35, 38), ("mauve", 300, 25, 65),
)
#: Lightness a colour is stored with at least and at most.
LIGHTNESS = (6, 94)
HOOK_SCALE_TYPES = ("standard", "tunisian", "hookKit")
OWNED_STATUSES = ("available", "damaged", "replace")
CABLE_JOINS = ("s", "l", "mini")
#: Fibre names, folded, by origin.
FIBRES = {
    "animal": (
        "laine", "merinos", "alpaga", "mohair", "soie", "cachemire", "angora", "yak", "chameau", "lama",
        "vigogne", "qiviut", "wool", "merino", "alpaca", "llama", "vicuna", "silk", "cashmere", "camel",
        "wolle", "alpaka", "vikunja", "seide", "kaschmir", "kamel", "lana", "seda", "cachemira", "camello",
    ),
    "plant": (
        "coton", "lin", "bambou", "chanvre", "ramie", "jute", "soja", "ortie", "cotton", "linen",
        "flax", "bamboo", "hemp", "soy", "nettle", "baumwolle", "leinen", "bambus", "hanf", "nessel",
        "algodon", "lino", "bambu", "canamo", "ortiga", "yute", "ramio",
    ),
    "synthetic": (
        "viscose", "lyocell", "tencel", "modal", "acetate", "rayon", "viskose", "viscosa", "acetat", "acetato",
        "acrylique", "polyamide", "polyester", "nylon", "elasthanne", "polypropylene", "acrylic", "elastane", "spandex", "acryl",
        "polyacryl", "polyamid", "elasthan", "polypropylen", "acrilico", "poliamida", "poliester", "elastano", "polipropileno",
    ),
}

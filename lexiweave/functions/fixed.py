"""Fixed values that results depend on: word lists and tables, stated as they are."""

from __future__ import annotations

#: Beginnings of definitions that say little.
GENERIC_PREFIXES = (
    "a source of ", "a kind of ", "a type of ", "a form of ", "a state of ", "a quality of ", "the quality of ", "a person who ", "someone who ", "something that ", "a thing that ",
    "a place where ", "the act of ", "the process of ",
)
#: Words and phrases of broad domains.
BROAD_TERMS = (
    "organ", "eye", "vision", "visual", "sight", "perception", "retina", "color", "colour", "camera", "photograph", "picture", "image", "object", "device", "instrument", "tool", "machine",
    "glass", "lens", "skin", "exposure", "wine", "island", "electricity", "electrical", "discharge", "cloud",
)
BROAD_PHRASES = ("produced by", "resulting from", "exposure to", "made of", "passes through")
#: Words that carry nothing in definitions.
STOPWORDS = ("a", "an", "the", "of", "to", "in", "on", "for", "from", "by", "with", "and", "or", "as", "at", "is", "are", "was", "were", "be", "being", "been")
#: Words by which a definition says that it is loose.
HEDGES = ("vaguely", "loosely", "somewhat", "broadly", "roughly", "especially", "chiefly", "particularly", "generally")
#: Endings that are taken off a word, the first that fits.
SUFFIXES = ("ing", "edly", "ed", "es", "s", "er", "est", "ly", "ness", "ment", "tion", "ion")
#: Parts of speech and tags that decide the tier of a sense.
TIER_A_POS = (
    "article", "prep", "pron", "conj", "det", "particle", "contraction", "postp", "prefix", "suffix", "infix", "interfix", "circumfix", "symbol", "character", "punct", "phrase",
    "prep_phrase", "adv_phrase", "proverb", "intj", "romanization", "soft-redirect", "root",
)
TIER_A_TAGS = ("form-of", "alt-of", "alternative", "clipping", "ellipsis", "misspelling", "pronunciation-spelling", "morpheme", "abbreviation", "initialism", "acronym", "vulgar", "derogatory")
TIER_B_POS = ("name", "num")
TIER_B_TAGS = ("slang", "obsolete", "archaic", "dated", "historical", "nonstandard", "dialectal", "plural-only", "in-plural")
ALT_TAGS = ("alt-of", "alternative")
#: Languages whose scripts spell with combining marks, and signs that are letters in one language.
MARK_LANGUAGES = ("hi", "sa", "he")
EXTRA_LETTERS = {"fa": "‌‍", "he": "־׳״"}
CAPITALIZING_LANGUAGES = ("de",)
#: How keys are folded by language.
FULL_FOLD, KEEP_MARKS, PERSIAN_FOLD = ("la", "ang"), ("hi", "sa"), ("fa",)
PERSIAN_VARIANTS = ("يىكةۀ", "ییکهه")
#: Scores below which a neighbour in a language does not count, and their default.
KNN_FLOORS = {
    "la": 0.826, "ru": 0.846, "ja": 0.826, "ar": 0.836, "ga": 0.838, "hi": 0.848, "sa": 0.831, "he": 0.845, "fa": 0.858, "de": 0.817, "pl": 0.823, "es": 0.838, "zh": 0.824, "ko": 0.839,
    "el": 0.846, "cy": 0.842, "sw": 0.843, "ang": 0.844, "non": 0.852, "is": 0.844,
}
KNN_FLOOR = 0.78
FALLBACK_FLOORS = {
    "la": 0.882, "ru": 0.875, "ja": 0.865, "ar": 0.875, "ga": 0.873, "hi": 0.867, "sa": 0.871, "he": 0.877, "fa": 0.871, "de": 0.878, "pl": 0.871, "es": 0.886, "zh": 0.862, "ko": 0.868,
    "el": 0.874, "cy": 0.876, "sw": 0.878, "ang": 0.881, "non": 0.875, "is": 0.878,
}
RESCUE_FLOORS = {
    "la": 0.799, "ru": 0.800, "ja": 0.822, "ar": 0.784, "ga": 0.801, "hi": 0.799, "sa": 0.787, "he": 0.785, "fa": 0.787, "de": 0.815, "pl": 0.816, "es": 0.795, "zh": 0.817, "ko": 0.800,
    "el": 0.804, "cy": 0.799, "sw": 0.791, "ang": 0.791, "non": 0.788, "is": 0.796,
}
#: Most results of a tree by breadth and depth.
MAX_RESULTS = {(1, 1): 2, (1, 2): 3, (1, 3): 4, (2, 1): 3, (2, 2): 7, (2, 3): 15, (3, 1): 4, (3, 2): 13, (3, 3): 40}

#: Codes under which sources write a language.
LANGUAGE_ALIASES = {"zh": ("zh", "cmn")}

# ---- names: patterns, vocabularies and limits as they hold for readers of name glosses, all without regard to letter case; fixed values

PLACE_WORDS = (
    "city|town|village|hamlet|river|mountain|lake|island|state|province|"
    "country|county|region|district|commune|municipality|borough|suburb|"
    "neighborhood|neighbourhood|census-designated place|unincorporated|"
    "placename|place name|place-name|locality|locale|civil parish|parish|"
    "prefecture|ward|settlement|community|ghost town|local government area"
)
NAME_FORM_OF = (
    r"^(?:nominative|genitive|dative|accusative|ablative|vocative|locative|instrumental|oblique)\b.{0,40}\bof\b"
    r"|^(?:alternative|variant|obsolete|archaic) (?:form|spelling) of\b"
    r"|\b(?:singular|plural|definite|indefinite) of\b"
    r"|^(?:inflection|romanization|transliteration) of\b"
)
NAME_FORM_TAGS = ("form-of", "alt-of", "alternative")
#: Kinds of names in the order in which they are asked.
NAME_KINDS = (
    ("GIVEN", r"\bgiven name\b|\bfirst name\b|\bforename\b|^an? (?:male|female|unisex|masculine|feminine) name\b"),
    ("SURNAME", r"\bsurname\b|\bfamily name\b|\blast name\b"),
    ("PATRONYMIC", r"\b(?:patronymic|matronymic)\b"),
    (
        "PLACE",
        rf"^an? (?:[a-z-]+ ){{0,3}}(?:{PLACE_WORDS})\b|^an? place (?:in|of)\b|^a number of places\b|^the capital (?:city )?of\b|\((?:a|an|the) (?:{PLACE_WORDS})\b",
    ),
)
DIMINUTIVE = r"\b(?:diminutive|pet form|short form|hypocorism|hypocoristic|nickname)\b"
UNISEX_PAIR = r"\b(?:male\s+(?:or|and)\s+female|female\s+(?:or|and)\s+male|common[- ]gender)\b"
PERSONAL_NAME = r"(?:given\s+name|surname|family\s+name|patronymic|matronymic|name)"
GENDER_WORDS = (("f", "female|feminine"), ("m", "male|masculine"), ("x", "unisex|epicene"))
CATEGORY_KINDS = {
    "given names": "GIVEN", "forenames": "GIVEN", "surnames": "SURNAME", "family names": "SURNAME", "nomina gentilia": "SURNAME",
    "patronymic surnames": "PATRONYMIC", "matronymic surnames": "PATRONYMIC", "patronymics": "PATRONYMIC", "matronymics": "PATRONYMIC",
}
CATEGORY_MODIFIERS = ("possessive",)
CATEGORY_CONNECTORS = ("renderings of ", "diminutives of ", "augmentatives of ")
MEANING_MARK = "(?:meaning|literally|lit\\.)\\s*[\"“'‘«]([^\"”'’»]{1,80})[\"”'’»]"
EQUIVALENT = r"\bequivalent to English\s+([A-Z][\w'’-]*)"
QUOTED_SPAN = '["“«]([^"”»]{1,80})["”»]'
PAREN_SPAN = r"\(([^()]{0,300})\)"
ANCHOR = r"\b(?:from|derived from|borrowed from|inherited from|cognate with|calque of|contraction of|composed of|compound of|equivalent to|via)\b"
BOILERPLATE = (
    r"^(?:stem|continuative|attributive|conjunctive|combining|inflect\w*|perfective|imperfective|classical|literary|colloquial|honorific)\b"
    r"|^(?:a |an |the )?(?:form|variant|spelling|reading|romani[sz]ation|transliteration|transcription|abbreviation|contraction)\b"
    r"|\bof the (?:verb|noun|adjective|name)\b"
    r"|^(?:see|cf\.?|compare)\b"
    r"|^(?:given name|surname|personal name|a name)\b"
)
#: Abbreviations whose point ends no sentence.
ABBREVIATIONS = r"cf|e\.g|i\.e|lit|c|ca|fl|Mr|St"
NO_ETYMOLOGY_LANGUAGES = ("ja", "zh")
MEANING_CHANNELS = ("GLOSS_MEANING", "ETYM_MARKER", "ETYM_QUOTED")
MEANING_CHARS, EQUIVALENT_CHARS, SPAN_CHARS, SPANS, TOKENS, TOKEN_CHARS = 400, 120, 80, 4, 12, 80
#: Words of meanings that join to everything.
NAME_STOPWORDS = (
    "a an the of and or to in from for with by on at as is are was were be been "
    "this that these those it its his her their our your my he she they we you i "
    "also see used use using such more most very not no "
    "name names given surname surnames family first last male female masculine "
    "feminine unisex form forms variant variants spelling diminutive short pet "
    "equivalent english meaning literally lit means derived derivative cognate "
    "son daughter child born place city town river god goddess mythology saint "
    "one two three ancient modern old new common word words letter"
)
#: Phrases behind which a name's text names another one.
NAME_TRIGGERS = (
    ("EQUIV_EN", r"\bequivalent to English\s+(.+)"),
    ("VARIANT_OF", r"\bvariant of\s+(.+)"),
    ("DIMINUTIVE_OF", r"\b(?:diminutive|pet form|short form|hypocorism|hypocoristic|nickname)(?:\s+of|\s+for)?\s+(.+)"),
    ("FEM_EQUIV", r"\bfeminine equivalents?\s+(.+)"),
    ("MASC_EQUIV", r"\bmasculine equivalents?\s+(.+)"),
)
TRIGGER_LEAD = r"^(?:the|a|an)\s+|^(?:male|female|unisex|masculine|feminine)\s+|^(?:given name|surname)\s+"
TRIGGER_PARTS = r"\s*,\s*|\s+or\s+|\s+and\s+"
TRIGGER_TARGETS = 3

# ---- romanization; fixed values

CYRILLIC_LETTERS = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
GREEK_LETTERS = {
    "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x",
    "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
}
ROMAN_CHARS = 400
ROMAN_TAGS = ("romanization", "romanisation", "transliteration")
INFLECTION_TAGS = (
    "plural", "singular", "dual", "genitive", "dative", "accusative", "nominative", "instrumental", "locative", "vocative", "prepositional", "partitive", "ablative", "oblique", "ergative", "construct",
    "past", "present", "future", "participle", "gerund", "infinitive", "imperative", "perfective", "imperfective", "aorist", "subjunctive", "comparative", "superlative", "definite", "indefinite",
    "possessive", "diminutive", "feminine", "masculine", "neuter", "inflection-template", "error-unknown-tag", "table-tags", "class",
    "non-past", "indicative", "formal", "informal", "polite", "sequential", "conditional", "causative", "passive", "honorific", "plain",
)
INFLECTION_SOURCES = ("conjugation", "declension", "inflection")
HEAD_KEYS = ("tr", "rom", "roman", "romanization", "translit", "latin")
MANDARIN_TAGS = ("mandarin", "standard-chinese", "hanyu-pinyin", "pinyin", "putonghua")
TOPOLECT_TAGS = (
    "min-nan", "hokkien", "cantonese", "jyutping", "yue", "hakka", "gan", "wu", "xiang", "min-dong", "min-bei", "poj", "tai-lo", "taiwanese", "teochew", "shanghainese",
)
SOUND_SKIP_KEYS = ("tags", "ipa", "audio", "raw_tags", "note", "homophone", "rhymes", "hyphenation", "ogg_url", "mp3_url", "wav_url")
#: Where a script's romanization is looked for, in order.
ROMAN_SOURCES = {
    "Cyrl": ("forms_tagged", "head_templates", "forms_romankey"), "Grek": ("forms_tagged", "forms_romankey"), "Deva": ("forms_tagged", "head_templates", "forms_romankey"),
    "Arab": ("forms_tagged", "head_templates", "forms_romankey"), "Hebr": ("forms_tagged", "head_templates", "forms_romankey"), "Jpan": ("forms_tagged", "forms_romankey"),
    "Kore": ("forms_tagged", "forms_romankey"), "Hani": ("sounds_mandarin",),
}

"""Fixed values of the data model: enumerations, limits and word lists."""

# Scopes in the order of their bits.
SCOPES = ("sense", "phrase", "form", "example", "resource")
SCOPE_BITS = {s: 1 << i for i, s in enumerate(SCOPES)}
SECTIONS = ("definitions", "idioms", "phrasal-verbs", "derived-forms", "grammar-usage")
ROLES = ("definition", "qualifier", "guidance", "expression", "example", "context", "heading")

# Ranks by scope and by semantic role.
POOL_TIER = {"sense": 3, "phrase": 3, "form": 3, "resource": 2, "example": 1}
RESULT_PRIORITY = {"sense": 4, "phrase": 3, "form": 3, "resource": 2, "example": 1}
RETRIEVAL_ROLE = {"definition": 2, "guidance": 2, "expression": 2, "example": 2, "qualifier": 1, "context": 1, "heading": 0}
EVIDENCE_ROLE = {"definition": 3, "expression": 3, "guidance": 2, "example": 2, "qualifier": 1, "context": 1, "heading": 0}
KIND_RANK = {"headword": 0, "variant": 1, "phrase": 2, "pattern": 3, "etymology": 4, "inflection": 5}

# Limits of a search.
TYPO_LIMIT, TIER_LIMIT, GROUP_LIMIT, EVIDENCE_LIMIT, CORROBORATION_LIMIT = 128, 4096, 512, 8, 8
SEGMENT_LENGTH = 200
DOT_SCALE, BAND_WIDTH = 16129, 0.004999999888241291
WILSON_Z = 1.959963984540054

# Weights of the reverse score.
COMPACTNESS, OVERALL, POSITION, LEADING, COVERAGE, RUN, BRACKET, NEGATION = 40, 120, 60, 80, 30, 3, 90, 45

# Word lists of the English planner.
STOP_WORDS = "a an the to of on no i and or".split()
LIGHT_WORDS = (
    "a am an and are as at be been being but by could do for from has have he her him i in is it its me my of on or our she that the their them "
    "this to us was we were will with would you your"
).split()
PLACEHOLDERS = "one oneself sb sb's somebody someone something sth sth's herself himself itself myself ourselves themselves yourself yourselves".split()
PERSON_WORDS = "her him me one sb somebody someone them us you".split()
THING_WORDS = "it something sth that this".split()

# Weights of level and frequency labels, and base weights of scopes.
LEVEL_WEIGHT = {"A1": 160, "A2": 120, "B1": 85, "B2": 50, "C1": 25, "C2": 10}
FREQUENCY_WEIGHT = {"3000": 40, "5000": 20}
SCOPE_WEIGHT = {"sense": 160, "phrase": 160, "form": 60, "example": 30, "resource": 60}

# Kinds of cross-references by their label.
REFERENCE_KINDS = {
    "[syn]": "synonym", "see also": "see-also", "compare": "compare", "=": "equivalent", "[opp]": "antonym", "wordfinder note at": "topic-note",
    "more at": "more-at", "synonyms at": "topic-note", "[idm] see": "related", "note at": "note-at", "related noun": "related",
    "language bank at": "topic-note", "word family at": "topic-note", "homophones at": "topic-note", "past tense, past participle of": "inflection",
    "": "generic", "past tense of": "inflection", "pl. of": "inflection", "past part. of": "inflection", "express yourself at": "topic-note",
    "third person of": "inflection", ",": "punctuation", "pres. part. of": "inflection", "(comparative of": "inflection", "singular of": "inflection",
}

# Brackets, opening and closing.
OPENING, CLOSING = "([{<【〔《〈「『", ")]}>】〕》〉」』"

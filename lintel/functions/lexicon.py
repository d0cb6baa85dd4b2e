"""Word lists and weights."""

# Fixed values of the linkage domain; results depend on them.
STOPWORDS = "the and for with from vol volume edition series part no op major minor".split()
ENSEMBLE_HINTS = (
    "orchestra philharmonic symphony ensemble quartet quartett trio quintet choir chorus consort players sinfonia academy capella coro"
    " chamber opera filharmonica radio baroque knot jupiter inalto psophos rso lpo rlpo bbc"
).split()
GENERIC_ARTIST_TOKENS = (
    "orchestra philharmonic symphony ensemble quartet quartett trio quintet choir chorus consort players sinfonia academy capella coro"
    " chamber opera baroque"
).split()
GENERIC_TITLE_TOKENS = (
    "chamber works work symphonies symphony sonatas sonata concertos concerto quartets quartet lieder orchestral solo piano violin string"
).split()
GENERIC_LINE_PREFIXES = ["sols", "sols incl", "incl", "label", "with"]
SKIPPED_SEGMENTS = ["sols", "sols.", "soloists", "soloist", "with"]
#: Italic phrases that name no work.
NO_WORKS = ["gramophone", "review"]
INSTRUMENTS = {
    "pf": "piano", "fp": "fortepiano", "pno": "piano", "piano": "piano", "fortepiano": "fortepiano", "vn": "violin", "violin": "violin",
    "va": "viola", "viola": "viola", "vc": "cello", "cello": "cello", "db": "double bass", "double": "double", "bass": "bass", "fl": "flute",
    "flute": "flute", "ob": "oboe", "oboe": "oboe", "cl": "clarinet", "clarinet": "clarinet", "bn": "bassoon", "bassoon": "bassoon",
    "hn": "horn", "horn": "horn", "tpt": "trumpet", "trumpet": "trumpet", "trb": "trombone", "trombone": "trombone", "hp": "harp",
    "harp": "harp", "org": "organ", "organ": "organ", "hpd": "harpsichord", "harpsichord": "harpsichord", "mandolin": "mandolin",
    "lute": "lute", "cornett": "cornett", "gtr": "guitar", "guitar": "guitar", "perc": "percussion", "percussion": "percussion",
    "sop": "soprano", "soprano": "soprano", "mez": "mezzo", "mezzo-soprano": "mezzo", "mezzo": "mezzo", "counterten": "countertenor",
    "countertenor": "countertenor", "ten": "tenor", "tenor": "tenor", "bar": "baritone", "baritone": "baritone", "cond": "conductor",
    "conductor": "conductor",
}
FEATURE_WEIGHTS = {"title": 0.35, "composer": 0.1, "performer": 0.25, "ensemble": 0.15, "conductor": 0.1, "instrument": 0.05, "label": 0.1, "year": 0.05}
TEMPLATE_WEIGHTS = {
    "title": 1.0, "title_short": 1.0, "title_sorted": 0.7, "title_reversed": 0.7, "title_ngrams": 0.8, "title_shuffle": 0.6, "work": 0.9,
    "work_ngrams": 0.8, "composer": 1.4, "composer_title": 1.2, "composer_work": 1.2, "performer": 1.7, "performer_title": 2.3,
    "performer_instrument": 0.9, "performer_ensemble": 2.2, "performer_composer": 2.1, "performer_work": 2.0, "ensemble": 1.8,
    "ensemble_title": 1.5, "conductor": 1.1, "conductor_title": 1.4, "conductor_composer": 1.0, "instrument_title": 1.1, "label_title": 0.8,
}
UNKNOWN_TEMPLATE_WEIGHT = 0.5
PERFORMER_BOOST = 1.5
#: Families in the order in which they are filled, and the most queries of each.
FAMILY_CAPS = {"title": 2, "work": 2, "performer": 4, "ensemble": 2, "composer": 3, "conductor": 2, "label": 1, "instrument": 1}
TEMPLATE_CAPS = {
    "performer": 1, "performer_composer": 1, "performer_ensemble": 1, "performer_title": 2, "performer_work": 1, "performer_instrument": 1,
    "composer": 1, "composer_title": 1, "composer_work": 2, "ensemble": 1, "ensemble_title": 2, "conductor": 1, "conductor_title": 1,
    "conductor_composer": 1,
}

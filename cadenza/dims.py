"""The fixed vocabularies, and DataFrames of them. All are small and of a fixed size, so joins broadcast them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names, spellings, chord and scale vocabularies, labels and colours must equal those that users know.

SHARPS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
FLATS = ["C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B"]
FLAT_KEYS = ["F", "Bb", "Eb", "Ab", "Db", "Gb"]

#: (id, label, symbol, intervals)
CHORD_TYPES = [
    ("major", "Maior", "", [0, 4, 7]),
    ("minor", "Menor", "m", [0, 3, 7]),
    ("dim", "Diminuto", "dim", [0, 3, 6]),
    ("aug", "Aumentado", "aug", [0, 4, 8]),
    ("maj7", "Maior com 7ª maior", "maj7", [0, 4, 7, 11]),
    ("min7", "Menor com 7ª menor", "m7", [0, 3, 7, 10]),
    ("dom7", "Dominante (7ª menor)", "7", [0, 4, 7, 10]),
    ("halfDim7", "Meio-diminuto", "m7(b5)", [0, 3, 6, 10]),
    ("dim7", "Diminuto com 7ª diminuta", "dim7", [0, 3, 6, 9]),
]

#: (id, label, intervals)
SCALES = [
    ("major", "Maior (Jonico)", [0, 2, 4, 5, 7, 9, 11]),
    ("dorian", "Dorico", [0, 2, 3, 5, 7, 9, 10]),
    ("phrygian", "Frigio", [0, 1, 3, 5, 7, 8, 10]),
    ("lydian", "Lidio", [0, 2, 4, 6, 7, 9, 11]),
    ("mixolydian", "Mixolidio", [0, 2, 4, 5, 7, 9, 10]),
    ("aeolian", "Menor Natural (Eolio)", [0, 2, 3, 5, 7, 8, 10]),
    ("locrian", "Locrio", [0, 1, 3, 5, 6, 8, 10]),
    ("pentatonicMajor", "Pentatonica Maior", [0, 2, 4, 7, 9]),
    ("pentatonicMinor", "Pentatonica Menor", [0, 3, 5, 7, 10]),
    ("blues", "Blues", [0, 3, 5, 6, 7, 10]),
    ("harmonicMinor", "Menor Harmonica", [0, 2, 3, 5, 7, 8, 11]),
    ("melodicMinor", "Menor Melodica", [0, 2, 3, 5, 7, 9, 11]),
    ("bluesMajor", "Blues Maior", [0, 2, 3, 4, 7, 9]),
    ("wholeTone", "Tons Inteiros", [0, 2, 4, 6, 8, 10]),
    ("dimWH", "Diminuta (Tom-Semitom)", [0, 2, 3, 5, 6, 8, 9, 11]),
    ("dimHW", "Diminuta Dom-Dim (Semitom-Tom)", [0, 1, 3, 4, 6, 7, 9, 10]),
    ("bebopDominant", "Bebop Dominante", [0, 2, 4, 5, 7, 9, 10, 11]),
    ("bebopMajor", "Bebop Maior", [0, 2, 4, 5, 7, 8, 9, 11]),
    ("harmonicMajor", "Maior Harmonica", [0, 2, 4, 5, 7, 8, 11]),
    ("hungarianMinor", "Hungara Menor", [0, 2, 3, 6, 7, 8, 11]),
]

SCALE_GROUPS = [
    ("Modos Gregos", ["major", "dorian", "phrygian", "lydian", "mixolydian", "aeolian", "locrian"]),
    ("Pentatonicas e Blues", ["pentatonicMajor", "pentatonicMinor", "blues", "bluesMajor"]),
    ("Simetricas", ["wholeTone", "dimWH", "dimHW"]),
    ("Bebop", ["bebopDominant", "bebopMajor"]),
    ("Outras", ["harmonicMinor", "melodicMinor", "harmonicMajor", "hungarianMinor"]),
]

#: Keys of a computer keyboard for notes: (key, pitch class, octave)
KEY_MAP = [
    ("a", 0, 3), ("w", 1, 3), ("s", 2, 3), ("e", 3, 3), ("d", 4, 3), ("f", 5, 3), ("t", 6, 3), ("g", 7, 3), ("y", 8, 3), ("h", 9, 3), ("u", 10, 3), ("j", 11, 3),
    ("k", 0, 4), ("o", 1, 4), ("l", 2, 4), ("p", 3, 4), (";", 4, 4), ("'", 5, 4),
]
PRESET_IDS = ["piano", "rhodes", "nylon", "pad", "organ", "wurlitzer"]
DEFAULT_PRESET = "piano"
BEAT_LABELS = ["1", "e", "2", "e", "3", "e", "4", "e"]
FUNCTION_COLORS = {"T": "var(--color-tonic)", "SD": "var(--color-subdominant)", "D": "var(--color-dominant)"}
QUIZ_MODES = ["interval", "chordType", "degree", "chordId"]

INTERVAL_LABELS = ["U", "ST", "T", "m3", "M3", "4J", "TT", "5J", "m6", "M6", "m7", "M7"]

#: (minor, degree from 1, numeral, chord type, function, semitones above the key)
FIELD = [
    (False, 1, "I", "maj7", "T", 0),
    (False, 2, "ii", "min7", "SD", 2),
    (False, 3, "iii", "min7", "T", 4),
    (False, 4, "IV", "maj7", "SD", 5),
    (False, 5, "V", "dom7", "D", 7),
    (False, 6, "vi", "min7", "T", 9),
    (False, 7, "vii°", "halfDim7", "D", 11),
    (True, 1, "i", "min7", "T", 0),
    (True, 2, "iiø", "halfDim7", "SD", 2),
    (True, 3, "III", "maj7", "T", 3),
    (True, 4, "iv", "min7", "SD", 5),
    (True, 5, "v", "min7", "D", 7),
    (True, 6, "VI", "maj7", "SD", 8),
    (True, 7, "VII", "dom7", "SD", 10),
]

#: (category, label, semitones above the key, chord type)
CHROMATIC = [
    ("secondary-dominants", "V7/ii", 9, "dom7"),
    ("secondary-dominants", "V7/iii", 11, "dom7"),
    ("secondary-dominants", "V7/IV", 0, "dom7"),
    ("secondary-dominants", "V7/V", 2, "dom7"),
    ("secondary-dominants", "V7/vi", 4, "dom7"),
    ("modal-interchange", "bVII", 10, "major"),
    ("modal-interchange", "bVI", 8, "major"),
    ("modal-interchange", "bIII", 3, "major"),
    ("modal-interchange", "iv", 5, "minor"),
    ("diminished-passing", "#Idim", 1, "dim7"),
    ("diminished-passing", "#IIdim", 3, "dim7"),
    ("diminished-passing", "#IVdim", 6, "dim7"),
]

#: The matcher's vocabulary: (quality, intervals as listed, display symbol)
TEMPLATES = [
    ("maj", [0, 4, 7], ""),
    ("min", [0, 3, 7], "m"),
    ("dim", [0, 3, 6], "dim"),
    ("aug", [0, 4, 8], "aug"),
    ("5", [0, 7], "5"),
    ("maj7", [0, 4, 7, 11], "maj7"),
    ("min7", [0, 3, 7, 10], "m7"),
    ("dom7", [0, 4, 7, 10], "7"),
    ("sus2", [0, 2, 7], "sus2"),
    ("sus4", [0, 5, 7], "sus4"),
    ("add9", [0, 4, 7, 2], "add9"),
    ("minadd9", [0, 3, 7, 2], "m(add9)"),
    ("6", [0, 4, 7, 9], "6"),
    ("min6", [0, 3, 7, 9], "m6"),
    ("add11", [0, 4, 5, 7], "add11"),
    ("minadd11", [0, 3, 5, 7], "m(add11)"),
    ("6no3", [0, 7, 9], "6(no3)"),
    ("sus4add9", [0, 2, 5, 7], "sus4(9)"),
]

#: (id, name, description, mode, preset, bpm, steps as (degree, label, intervals, offset in eighths))
EXAMPLES = [
    ("cadencia-basica", "Cadência Básica", "I - IV - V - I: O fundamento de tudo. A dominante (V) cria tensão que resolve na tônica (I).", "major", "piano", 100,
     [(0, "I", None, None), (3, "IV", None, None), (4, "V", None, None), (0, "I", None, None)]),
    ("pop", "Pop Universal", "I - V - vi - IV: A progressão mais famosa do pop. Let It Be, No Woman No Cry, Ai Se Eu Te Pego.", "major", "piano", 110,
     [(0, "I", None, None), (4, "V", None, None), (5, "vi", None, None), (3, "IV", None, None)]),
    ("ii-v-i", "Jazz / Bossa Nova", "ii - V - I: A espinha dorsal do jazz e da bossa nova. Wave, Corcovado, Samba de Uma Nota So.", "major", "rhodes", 120,
     [(1, "ii", None, None), (4, "V", None, None), (0, "I", None, None)]),
    ("garota-de-ipanema", "Garota de Ipanema", "I - II7 - ii - V - iii: O II7 é dominante secundário (V7/V), fora do campo harmônico. Tom Jobim.", "major", "rhodes", 140,
     [(0, "I", None, None), (0, "I", None, None), (None, "II7", [2, 6, 9, 0], -1), (None, "II7", [2, 6, 9, 0], None), (1, "ii", None, -1), (4, "V", None, None), (2, "iii", None, None), (2, "iii", None, None)]),
    ("triste", "Balada / Triste", "vi - IV - I - V: Começa na relativa menor, criando uma sonoridade melancólica antes de resolver.", "major", "pad", 75,
     [(5, "vi", None, None), (3, "IV", None, None), (0, "I", None, None), (4, "V", None, None)]),
    ("menor-basica", "Cadência Menor", "i - iv - v - i: A mesma lógica da cadência básica, mas no modo menor. Sente a diferença de clima.", "minor", "piano", 90,
     [(0, "i", None, None), (3, "iv", None, None), (4, "v", None, None), (0, "i", None, None)]),
    ("andaluza", "Cadência Andaluza", "i - VII - VI - V: Descendente e dramática. O V maior (da menor harmônica) cria a resolução frígia característica. Flamenco e rock.", "minor", "nylon", 85,
     [(0, "i", None, None), (6, "VII", None, None), (5, "VI", None, None), (None, "V", [7, 11, 2], None)]),
]

#: (semitones, label)
INTERVAL_NAMES = [
    (0, "Uníssono"),
    (1, "Segunda menor"),
    (2, "Segunda maior"),
    (3, "Terça menor"),
    (4, "Terça maior"),
    (5, "Quarta justa"),
    (6, "Trítono"),
    (7, "Quinta justa"),
    (8, "Sexta menor"),
    (9, "Sexta maior"),
    (10, "Sétima menor"),
    (11, "Sétima maior"),
    (12, "Oitava justa"),
]

QUIZ_CHORD_TYPES = ["major", "minor", "dim", "aug", "maj7", "min7", "dom7"]
QUIZ_CHORD_IDS = ["major", "minor", "dom7", "maj7", "min7", "dim"]

#: (type, label, colour)
SECTION_TYPES = [
    ("intro", "Intro", "#8b5cf6"),
    ("verso", "Verso", "#3b82f6"),
    ("pre-refrao", "Pré-Refrão", "#06b6d4"),
    ("refrao", "Refrão", "#f59e0b"),
    ("ponte", "Ponte", "#10b981"),
    ("solo", "Solo", "#ec4899"),
    ("outro", "Outro", "#6366f1"),
    ("custom", "Personalizado", "#9ca3af"),
]

PALETTE = ["#3b82f6", "#8b5cf6", "#06b6d4", "#f59e0b", "#10b981", "#ec4899", "#6366f1", "#f97316", "#14b8a6", "#e11d48", "#84cc16", "#9ca3af"]
ORPHANS_NAME, ORPHANS_COLOR = "Sem seção", "#9ca3af"

#: Time signature to eighth-note dots
DOTS = {"4/4": 8, "3/4": 6, "2/4": 4, "6/8": 6}

#: Bass strings: (open note, octave), lowest string first
BASS = [(4, 1), (9, 1), (2, 2), (7, 2)]
FRETS = 12

ANALYSIS = {
    "cadence": "Contém um movimento SD - D - T (preparação - tensão - resolução), o padrão mais forte da harmonia tonal.",
    "circular": "Começa e termina na tônica, criando uma sensação circular e estável.",
    "suspended": "Começa na tônica e termina na dominante, deixando uma sensação de suspensão.",
    "moving": "Não começa na tônica, o que cria uma sensação de movimento desde o início.",
    "chromatic": "Usa acordes fora do campo harmônico, adicionando cor e surpresa.",
}

GP_ERRORS = {
    "legacy-binary": "Formato antigo do Guitar Pro (.gp3/.gp4/.gp5). Apenas arquivos .gp do Guitar Pro 7 ou 8 são suportados.",
    "gpx-container": "Arquivo .gpx do Guitar Pro 6. Apenas arquivos .gp do Guitar Pro 7 ou 8 são suportados.",
    "not-a-zip": "Este arquivo não parece ser um arquivo do Guitar Pro.",
    "not-a-gp-file": "O arquivo está compactado, mas não contém uma partitura do Guitar Pro.",
    "corrupt": "O arquivo parece estar corrompido e não pode ser lido.",
}

#: Page formats, lengths in millimetres
PAGES = {
    "a4": {"pageW": 210.0, "pageH": 297.0, "margin": 6.0, "barW": 8.0, "barH": 5.5, "barGap": 1.0, "sectionGapY": 4.0, "commentGap": 3.0, "colGap": 5.0, "numCols": 2, "barsTopOffset": 5.0, "commentLineHeight": 3.0, "commentBesideMinW": 20.0},
    "ipad-air": {"pageW": 160.0, "pageH": 228.0, "margin": 4.0, "barW": 10.0, "barH": 7.0, "barGap": 1.2, "sectionGapY": 5.0, "commentGap": 3.5, "colGap": 5.0, "numCols": 2, "barsTopOffset": 5.5, "commentLineHeight": 3.2, "commentBesideMinW": 20.0},
}

MAX_STEPS = 64
UNKNOWN = "?"

# End of the fixed values.


def chord_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *row) for k, row in enumerate(CHORD_TYPES)], "pos int, type_id string, label string, symbol string, intervals array<int>")


def scales(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *row) for k, row in enumerate(SCALES)], "pos int, scale_id string, label string, intervals array<int>")


def field_templates(spark: SparkSession) -> DataFrame:
    kinds = {row[0]: (row[2], row[3]) for row in CHORD_TYPES}
    return spark.createDataFrame([(*row, *kinds[row[3]]) for row in FIELD], "is_minor boolean, degree int, numeral string, type_id string, function string, above int, symbol string, intervals array<int>")


def chromatic(spark: SparkSession) -> DataFrame:
    kinds = {row[0]: row[3] for row in CHORD_TYPES}
    return spark.createDataFrame([(*row, kinds[row[3]]) for row in CHROMATIC], "category string, label string, above int, type_id string, intervals array<int>")


def keys(spark: SparkSession) -> DataFrame:
    """The 24 keys."""
    return spark.createDataFrame([(root, minor) for root in range(12) for minor in (False, True)], "key_root int, is_minor boolean")


def template_masks(spark: SparkSession) -> DataFrame:
    """One row a pitch-class mask: all (root, quality) readings of it, in root and vocabulary order."""
    found: dict[int, list] = {}
    for root in range(12):
        for quality, intervals, symbol in TEMPLATES:
            mask = sum(1 << k for k in {(root + i) % 12 for i in intervals})
            found.setdefault(mask, []).append((root, quality, intervals, symbol))
    return spark.createDataFrame(list(found.items()), "mask int, readings array<struct<root:int,quality:string,intervals:array<int>,symbol:string>>")

"""The ligand rule pack: class codes, abbreviations, scaffold and inline patterns, for the rule operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholia.operators import parsing, rules

# fixed values: class codes, in the order they are looked for
CODES = ("Phen", "Bpy", "PyrOx", "PyrIm", "PyCam", "BiOX", "BiIM")

# fixed values: abbreviations by class, as they are written in lower case
ABBREVIATIONS = {
    "Bpy": (
        "bpy", "bipy", "dtbbpy", "dtbpy", "4,4'-tbu-bpy", "4,4-tbu-bpy", "4,4'-och3-bpy", "4,4'-ch3-bpy", "5,5'-ch3-bpy", "6,6'-ch3-bpy",
        "4,4'-cf3-bpy", "4,4'-nr2-bpy", "4,4'-nme2-bpy", "4,4'-ph-bpy", "4,4'-coch3-bpy", "4,4'-co2ch3-bpy", "py", "dmap", "3-f-py", "4-cn-py",
        "imdz", "5-cn-imdz", "5,5'-cf3-bpy", "picolylamine", "dpa",
    ),
    "Phen": (
        "phen", "bphen", "bathophenanthroline", "bcp", "bathocuproine", "bcpe", "neocuproine", "dmphen", "tmphen", "me4phen", "4,7-och3-phen",
        "4,7-och3-2,9-ch3-phen", "(meo)2phen", "terpy", "tbu-terpy", "4'-oh-terpy", "4'-och3-terpy", "4'-p-anisyl-terpy", "bpp", "mebpp", "mebpi", "ttbtpy",
    ),
    "PyrOx": ("pyrox", "pyox", "pyoxime", "pyr-indox", "4-och3-pybox", "4-cl-pybox", "pyboxipr", "pyboxsbu", "pybox", "phox"),
    "PyrIm": ("pyrim", "5-ph-pyrim"),
    "PyCam": ("pycam", "pycamh", "pycamcn", "pybcam", "pybcamcn", "bpycamcn", "bpycam", "4,4'-tbu-bpycamcn"),
    "BiOX": (
        "biox", "box", "bisoxazoline", "cy-biox", "r,r-ph-boxipr", "(s,s)-4-heptyl-biox", "(s,s)-sbu-biox", "r,r-ph-box", "pentr", "cycp",
        "(s,s)-ph-box", "(s)-sbu-biox",
    ),
    "BiIM": ("biim", "(s,s)-sbu-biim3-tbuph"),
}

# fixed values: scaffold patterns (case-insensitive, Unicode), class, confidence; the first or the most confident counts
SCAFFOLDS = tuple((f"(?iU){p}", cls, n) for p, cls, n in (
    (r"\bbis\s*\(?imida[zt]olin", "BiIM", 5), (r"\bdiimida[zt]olin", "BiIM", 5), (r"\bbis\s*\(?oxa[zt]olin", "BiOX", 5),
    (r"\b(?:4,5-dihydro-1[hh]?-)?imida[zt]ol-2-yl\)?pyridin", "PyrIm", 5), (r"\b(?:4,5-dihydro)?oxa[zt]ol-2-yl\)?pyridin", "PyrOx", 5),
    (r"\bpyridin.*(?:oxa[zt]olin|pyox)", "PyrOx", 4), (r"\bpyridin.*(?:imida[zt]olin)", "PyrIm", 4),
    (r"\b(?:pyridin|picolin)(?:e|yl)?-?(?:2,6-)?bis\(?carboximida", "PyCam", 5), (r"\b(?:pyridin|picolin)(?:e|yl)?-?carboximida", "PyCam", 4),
    (r"\bpyridin.*carboxamid", "PyCam", 4), (r"\bterpyridin", "Phen", 4),
    (r"\bpyridine-2,6-bis\s*\(?(?:4-isopropyl-2-oxa[zt]olin|4-methyl-1[hh]?-pyra[zt]ol)", "PyrOx", 4), (r"\b2,6-bis\s*\(?[\w-]*oxa[zt]olin", "BiOX", 4),
    (r"\bphenanthrolin", "Phen", 5), (r"\bbipyridin", "Bpy", 5), (r"\bdipyridin", "Bpy", 4), (r"\bamidoxim", "PyCam", 3), (r"\boxim", "PyrOx", 3),
    (r"\bamidin", "PyCam", 3), (r"\bpyridin", "Bpy", 2), (r"\b(?:tri|di|tetra)?pyridyl", "Bpy", 3), (r"\bpicolylamin", "Bpy", 4), (r"\boxazole", "BiOX", 3),
    (r"\bpyridyl.*carboxamidin", "PyCam", 4), (r"indeno.*oxa[zt]ol", "BiOX", 4), (r"\boxa[zt]olin", "BiOX", 3), (r"\bimida[zt]olin", "BiIM", 3),
    (r"\bimida[zt]ol", "Bpy", 2), (r"\bpyra[zt]olyl", "Phen", 3), (r"\bpyrazolyl.*pyridin", "Phen", 4), (r"pyridin", "Bpy", 1), (r"pyridyl", "Bpy", 1),
    (r"carboxamidin", "PyCam", 1), (r"amidoxim", "PyCam", 1), (r"oxazole", "BiOX", 1), (r"oxazolin", "BiOX", 1), (r"imidazolin", "BiIM", 1),
))

# fixed values: abbreviations inside running text
INLINE = tuple((f"(?iU){p}", cls, n) for p, cls, n in (
    (r"\bdtbb?py\b", "Bpy", 4), (r"\b(?:bpy|bipy)\b", "Bpy", 3), (r"\b(?:phen|bphen)\b", "Phen", 3), (r"\bbathocuproin\w*\b", "Phen", 4),
    (r"\bneocuproin\w*\b", "Phen", 4), (r"\b(?:tmphen|me4phen)\b", "Phen", 4), (r"\bpybox\w*\b", "PyrOx", 3), (r"\b(?:pyrox|pyox)\b", "PyrOx", 3),
    (r"\bpybcam\w*\b", "PyCam", 4), (r"\bpycam\w*\b", "PyCam", 3), (r"\bbiox\w*\b", "BiOX", 3), (r"(?:^|(?<=\s)|(?<=-)|(?<=/))box(?:$|(?=\s)|(?=,)|(?=\)))", "BiOX", 3),
    (r"\bbisoxazoline\b", "BiOX", 3), (r"\bbiim\w*\b", "BiIM", 3), (r"\bterpy\w*\b", "Phen", 3), (r"\bbpp\w*\b", "Phen", 3), (r"\bdmap\b", "Bpy", 4),
    (r"\bpyridine\b", "Bpy", 2),
))


def dictionary(spark: SparkSession) -> DataFrame:
    """(ord, key, cls) of the abbreviations."""
    rows = [(key, cls) for cls, keys in ABBREVIATIONS.items() for key in keys]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, key string, cls string")


def classify(rows: DataFrame, key: str, text: str, known: DataFrame | None = None) -> DataFrame:
    """rules.classify with this pack."""
    return rules.classify(rows, key, text, dictionary(rows.sparkSession), CODES, SCAFFOLDS, INLINE, valid=CODES, known=known)


def learn(rows: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rules.learn_references with this pack: dictionary and segments."""
    return rules.learn_references(rows, dictionary(rows.sparkSession), names, CODES, SCAFFOLDS)


def detect(queries: DataFrame) -> DataFrame:
    """parsing.detect_classes with this pack."""
    return parsing.detect_classes(queries, dictionary(queries.sparkSession), CODES, SCAFFOLDS, INLINE)

"""Fixed values of the nutrition and literature domains, and small DataFrames made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Milligrams in a unit.
UNIT_TO_MG = {"MG": 1.0, "UG": 0.001, "G": 1000.0}

# Daily values (unit, amount).
DAILY_VALUES = {
    "Vitamin C, total ascorbic acid": ("MG", 90.0), "Vitamin D (D2 + D3)": ("UG", 20.0), "Vitamin E (alpha-tocopherol)": ("MG", 15.0),
    "Vitamin K (phylloquinone)": ("UG", 120.0), "Vitamin A, RAE": ("UG", 900.0), "Folate, total": ("UG", 400.0), "Choline, total": ("MG", 550.0),
    "Niacin": ("MG", 16.0), "Riboflavin": ("MG", 1.3), "Thiamin": ("MG", 1.2), "Vitamin B-6": ("MG", 1.7), "Vitamin B-12": ("UG", 2.4),
    "Calcium, Ca": ("MG", 1300.0), "Iron, Fe": ("MG", 18.0), "Magnesium, Mg": ("MG", 420.0), "Phosphorus, P": ("MG", 1250.0),
    "Potassium, K": ("MG", 4700.0), "Sodium, Na": ("MG", 2300.0), "Zinc, Zn": ("MG", 11.0), "Selenium, Se": ("UG", 55.0),
    "Fiber, total dietary": ("G", 28.0), "Protein": ("G", 50.0), "Total lipid (fat)": ("G", 78.0),
}

# Nutrient to (chemical id, confidence) where no derived mapping exists.
MANUAL_CHEMICALS = {
    "Vitamin C, total ascorbic acid": ("MESH:D014786", 0.92), "Vitamin A, RAE": ("MESH:D014801", 0.9), "Vitamin D (D2 + D3)": ("MESH:D014807", 0.9),
    "Vitamin K (phylloquinone)": ("MESH:D014810", 0.9), "Vitamin E (alpha-tocopherol)": ("MESH:D014805", 0.88), "Choline, total": ("MESH:D002813", 0.85),
    "Protein": ("MESH:D011506", 0.75), "Total lipid (fat)": ("MESH:D010999", 0.75), "Fiber, total dietary": ("MESH:D005345", 0.8),
    "Folate, total": ("MESH:D005492", 0.85), "Iron, Fe": ("MESH:D007501", 0.9), "Magnesium, Mg": ("MESH:D008274", 0.88),
    "Potassium, K": ("MESH:D011188", 0.88), "Calcium, Ca": ("MESH:D002115", 0.92), "Zinc, Zn": ("MESH:D015043", 0.9),
}

# Normalised name to (chemical id, key), tried before any matching.
NAME_OVERRIDES = {
    "calcium, ca": ("MESH:D002115", "calcium"), "iron, fe": ("MESH:D007501", "iron"), "magnesium, mg": ("MESH:D008274", "magnesium"),
    "sodium, na": ("MESH:D012964", "sodium"), "potassium, k": ("MESH:D011188", "potassium"), "phosphorus, p": ("MESH:D010738", "phosphorus"),
    "zinc, zn": ("MESH:D015043", "zinc"), "copper, cu": ("MESH:D003315", "copper"), "manganese, mn": ("MESH:D008357", "manganese"),
    "selenium, se": ("MESH:D012640", "selenium"), "boron, b": ("MESH:D001911", "boron"), "chlorine, cl": ("MESH:D002701", "chlorine"),
    "chromium, cr": ("MESH:D002806", "chromium"), "cobalt, co": ("MESH:D003072", "cobalt"),
    "carbohydrate, by difference": ("MESH:D002245", "carbohydrates"), "carbohydrate, by summation": ("MESH:D002245", "carbohydrates"),
    "carbohydrate, other": ("MESH:D002245", "carbohydrates"), "ash": ("MESH:D000459", "ash"), "choline, total": ("MESH:D002813", "choline"),
    "choline, free": ("MESH:D002813", "choline"), "choline, from glycerophosphocholine": ("MESH:D002813", "glycerophosphocholine"),
    "choline, from phosphocholine": ("MESH:D002813", "phosphocholine"), "choline, from phosphotidyl choline": ("MESH:D002813", "phosphatidylcholine"),
    "choline, from sphingomyelin": ("MESH:D013162", "sphingomyelin"),
}

# Roles of genes.
PRO_GENES = ("TNF", "IL6", "IL1B", "CRP", "CCL2", "CCL5", "CXCL8", "NFKB1", "RELA", "JUN", "FOS", "MAPK8", "MAPK14", "CASP3", "CASP8", "BAX", "DDIT3")
ANTI_GENES = ("CAT", "SOD1", "SOD2", "GPX1", "GPX3", "GSR", "HMOX1", "NQO1", "IL10", "PPARG", "PPARGC1A", "ADIPOQ", "INSR", "SLC2A4", "AKT1", "PRKAA1", "PRKAA2")

# Weight of a direct-evidence code; unlisted codes have UNLISTED_CODE.
EVIDENCE_PRIORS = {"therapeutic": 1.0, "dosage": 0.9, "marker/mechanism": 0.8, "activity": 0.7, "expression": 0.6}
UNLISTED_CODE = 0.7

# Weight of a matching method; unlisted methods have UNLISTED_METHOD.
METHOD_WEIGHTS = {"exact": 0.95, "fuzzy": 0.8, "synonym": 0.7, "manual": 0.9, "bridge": 0.65}
UNLISTED_METHOD = 0.55

# Phrases and words.
EXCLUDED_FOODS = ("water enhancer", "drink enhancer", "liquid water", "flavor drops", "energy shot", "pre-workout", "supplement mix", "powder drink mix", "dietary supplement")
METABOLIC_WORDS = ("metabolic", "obesity", "diabetes", "glucose", "lipid", "insulin", "triglyceride", "hdl", "ldl", "cholesterol", "nafld", "nash", "fatty", "steatosis", "bmi", "hyperglycemia", "dyslipidemia")
NUTRIENT_WORDS = {
    "vitamins": ("vitamin", "tocopherol", "retinol", "thiamin", "riboflavin", "niacin", "ascorbic", "biotin"),
    "minerals": ("calcium", "iron", "zinc", "magnesium", "phosphorus", "potassium", "sodium"),
    "fatty_acids": ("fatty", "oleic", "linoleic", "palmitic", "epa", "dha", "mufa", "pufa"),
    "amino_acids": ("alanine", "arginine", "histidine", "glutamic", "glycine"),
    "metabolites": ("cholesterol", "caffeine", "glucose", "choline", "glutathione"),
}
UP_ACTIONS = ("increase", "activate", "upregulat", "induce")
DOWN_ACTIONS = ("decrease", "downregulat", "inhibit", "suppress", "reduce")

# Species by subject heading, and which one leads.
SPECIES = {
    "humans": "Human", "human": "Human", "male": "Human", "female": "Human", "mice": "Mouse", "rats": "Rat", "dogs": "Dog", "cats": "Cat", "rabbits": "Rabbit",
    "caenorhabditis elegans": "C. elegans", "c. elegans": "C. elegans", "zebrafish": "Zebrafish", "cell line": "Cellular", "cell lines": "Cellular",
    "organ culture techniques": "Organ culture",
}
SPECIES_ORDER = ("Human", "Mouse", "Rat", "C. elegans", "Zebrafish", "Dog", "Cat", "Rabbit", "Cellular", "Organ culture")

# Patterns of amounts and durations.
DOSE = r"\b\d+(?:\.\d+)?\s*(?:mg|μg|ug|g|kg|µg|ng|ml|mM|µM|uM|%)(?:\s*/\s*(?:kg|day|d|h))?"
DURATION = r"\b\d+(?:\.\d+)?\s*(?:h|hr|hrs|hour|hours|day|days|week|weeks|month|months)\b"

# Cue families; a sentence has a cue if any of its patterns is found.
CUES = {
    "up": (r"\bup[\-\s]?regulat\w+", r"\bincreas\w+", r"\benhanc\w+", r"\belevat\w+", r"\bactivat\w+", r"\bover[-\s]?express\w+", r"\binduc\w+", r"\baugmen\w+"),
    "down": (r"\bdown[\-\s]?regulat\w+", r"\bdecreas\w+", r"\breduc\w+", r"\bsuppress\w+", r"\binhibit\w+", r"\bknock[-\s]?down\w*", r"\bsilenc\w+", r"\bloss\b"),
    "bind": (r"\bbind\w+\b", r"\binteract\w+\b", r"\btarget\w+\b", r"\baffinity\b", r"\bligand\b", r"\breceptor\b", r"\bcomplex\b"),
    "modulate": (r"\bmodulat\w+\b", r"\bregulat\w+\b", r"\baffect\w+\b", r"\binfluenc\w+\b", r"\balter\w+\b"),
    "direct": (r"\bdirectly\b", r"\bspecifically\b", r"\bselectively\b", r"\btargets?\b", r"\bupregulates?\b", r"\bdownregulates?\b", r"\binduces?\b", r"\bsuppresses?\b", r"\binhibits?\b", r"\bactivates?\b"),
    "genetic": (r"\bpolymorphism(s)?\b", r"\bsnp(s)?\b", r"\bgenotype(s)?\b", r"\ballele(s)?\b", r"\bvariant(s)?\b", r"\bmutation(s)?\b"),
    "gene_context": (r"\bgene(s)?\b", r"\bmRNA\b", r"\bprotein(s)?\b", r"\bexpression\b", r"\bactivity\b", r"\benzyme(s)?\b", r"\breceptor(s)?\b", r"\btranscription\b", r"\bpromoter\b", r"\bknock[-\s]?down\b", r"\bsilenc\w+", r"\bmethylation\b", r"\bpathway(s)?\b", r"\bpolymorphism(s)?\b", r"\bgenotype(s)?\b", r"\bSNP(s)?\b", r"\bvariant(s)?\b"),
    "beverage": (r"\bsugar[-\s]?sweetened\b", r"\bbeverage(s)?\b", r"\bdrinks?\b", r"\bdrinkers\b"),
    "positive": (r"\bpromot\w+", r"\benhanc\w+", r"\bincreas\w+", r"\baccelerat\w+", r"\bprogression\b", r"\baggravat\w+", r"\bexacerbat\w+", r"\bmetastasi\w+", r"\bproliferat\w+", r"\bresistan\w+", r"\brisk\s*factor\b"),
    "negative": (r"\bsuppress\w+", r"\binhibit\w+", r"\battenuat\w+", r"\breduc\w+", r"\bprotect\w+", r"\bprevent\w+", r"\bblock\w+", r"\bchemo|radio\s*sensitiz\w+", r"\bgood\b.*\bprognos\w+", r"\bimprov\w+\s+\bsurvival\b", r"\btumor\s*suppressor\b"),
    "neutral": (r"\bno\b\s+(?:significant\s+)?(?:association|effect|change)\b", r"\bnot\s+associate\w*\b", r"\bunchang\w+\b", r"\bnonsignificant\b", r"\bns\b"),
    "intervention": (r"\btreated\s+with\b", r"\badministered\b", r"\bsupplement(?:ed|ation)\b", r"\bdiet(?:ary)?\b", r"\bintake\b", r"\bconsumption\b", r"\bconsume[sd]?\b", r"\bdrinking\b", r"\bdrinkers\b", r"\bdrinks?\b", r"\bfed\b", r"\bfeeding\b", r"\bdose\b", r"\bmg/kg\b", r"\bexposed\s+to\b", r"\bco[-\s]?treated\b", r"\bin\s+vitro\s+with\b", r"\bin\s+vivo\s+with\b", r"\bhabitual\b", r"\bcups?\s*/\s*day\b", r"\bcups?\s+per\s+day\b", r"\bper\s+day\b"),
    "enzyme": (r"\blecithin\s*[:-]?\s*cholesterol\s+acyltransferase\b", r"\blecithin\s*[:-]?\s*retinol\s+acyltransferase\b"),
    "coffee": (r"\bcoffee\b", r"\bcups?\s*/?\s*day\b", r"\bcups?\s+per\s+day\b"),
}

# Disease words in texts, in headings, and what never counts as a disease.
DISEASE_TERMS = (
    "disease", "disorder", "syndrome", "cancer", "tumor", "tumour", "carcinoma", "sarcoma", "neoplasm", "metastasis", "infection", "sepsis", "inflammation", "arthritis", "asthma",
    "colitis", "ulcerative colitis", "ibd", "hepatitis", "cirrhosis", "fibrosis", "diabetes", "obesity", "hypertension", "stroke", "ischemia", "infarction", "nephropathy",
    "neuropathy", "retinopathy", "dermatitis", "psoriasis", "alzheimer", "parkinson", "als", "autism", "schizophrenia", "depression", "pneumonia", "tuberculosis", "hiv", "aids",
)
HEADING_TERMS = (
    "disease", "disorder", "syndrome", "cancer", "tumor", "tumour", "carcinoma", "sarcoma", "neoplasm", "fibrosis", "hepatitis", "diabetes", "infection", "alzheimer", "parkinson",
    "psoriasis", "colitis", "retinopathy", "neuropathy", "nephropathy",
)
NOT_DISEASES = (
    "animals", "humans", "materials", "water", "male", "female", "cell line", "cells", "biomarkers", "risk factors", "cohort studies", "case-control studies", "odds ratio",
    "hazard ratio", "confidence intervals", "stomach", "liver", "kidney", "brain", "heart", "lung", "lungs", "colon", "prostate", "breast", "pancreas", "skin", "muscle", "adipose",
    "tissue", "tissues", "serum", "plasma", "urine", "blood", "milk", "saliva", "feces", "faeces", "hair", "nails", "ocular", "retina", "cornea", "bone",
)
DISEASE_SUFFIX = r"\b\w+(?:itis|opathy|oma|omas)\b"

# Names of compounds besides their own; the ambiguous ones only on demand.
COMPOUND_SYNONYMS = {
    "coffee": ("coffee intake", "coffee consumption", "coffee drinkers", "drinking coffee", "caffeinated coffee", "decaffeinated coffee", "decaf coffee", "espresso", "instant coffee", "filtered coffee", "unfiltered coffee", "brewed coffee"),
    "lecithin": ("lecithins", "phosphatidylcholine", "phosphatidylcholines"),
    "phosphatidylcholine": ("lecithins", "phosphatidylcholines"),
    "caffeine": ("1,3,7-trimethylxanthine",),
}
AMBIGUOUS_SYNONYMS = {"lecithin": ("pc",), "phosphatidylcholine": ("pc",)}
PROXY_SYNONYMS = {"coffee": ("caffeine",)}

# Months by name.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}


def either(words) -> str:
    """Pattern that finds any of some plain words."""
    return "|".join(w.replace("-", r"\-") for w in words)


def cue(name: str) -> str:
    """Pattern of a cue family: case ignored, word characters and borders of all scripts.

    The border that nearly all begin with stands in front of them all, so that it is looked for once a place.
    """
    bordered = [p for p in CUES[name] if p.startswith(r"\b") and ("|" not in p or "(" in p)]
    rest = [p for p in CUES[name] if p not in bordered]
    return "(?iU)" + "|".join([rf"\b(?:{'|'.join(p[2:] for p in bordered)})", *rest])


def daily_values(spark: SparkSession) -> DataFrame:
    """(nutrient_key, dv_mg)"""
    return spark.createDataFrame([(k.lower(), v * UNIT_TO_MG[u]) for k, (u, v) in DAILY_VALUES.items()], "nutrient_key string, dv_mg double")


def gene_roles(spark: SparkSession) -> DataFrame:
    """(gene, role)"""
    return spark.createDataFrame([(g, "pro") for g in PRO_GENES] + [(g, "anti") for g in ANTI_GENES], "gene string, role string")


def name_overrides(spark: SparkSession) -> DataFrame:
    """(name, id, key)"""
    return spark.createDataFrame([(k, *v) for k, v in NAME_OVERRIDES.items()], "name string, id string, key string")


def manual_chemicals(spark: SparkSession) -> DataFrame:
    """(nutrient, chemical_id, confidence)"""
    return spark.createDataFrame([(k, *v) for k, v in MANUAL_CHEMICALS.items()], "nutrient string, chemical_id string, confidence double")


def compound_lexicon(spark: SparkSession, compounds, ambiguous: bool = False, proxies: bool = False) -> DataFrame:
    """(compound, synonym): each compound's names, lower case."""
    rows = set()
    for c in (x.strip().lower() for x in compounds):
        names = (c, *COMPOUND_SYNONYMS.get(c, ()), *(AMBIGUOUS_SYNONYMS.get(c, ()) if ambiguous else ()), *(PROXY_SYNONYMS.get(c, ()) if proxies else ()))
        rows |= {(c, n) for n in names}
    return spark.createDataFrame(sorted(rows), "compound string, synonym string")

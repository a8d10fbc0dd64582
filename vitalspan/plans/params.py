"""Shipped parameter sets: concept ids, name lists, code lists and scores.

Everything here is data; the plans take these as arguments.
"""

from __future__ import annotations

# --- Fixed values: laboratory and drug concept ids -------------------------
AST, ALT, BILIRUBIN, ALP = 3013721, 3006923, 3024128, 3035995
CREATININE = 3016723
RENAL_MARKERS = (3016723, 4324383, 3051825)
LIVER_LABS = (AST, ALT, BILIRUBIN, ALP)

DRUGS = {
    "losartan": 1367500, "meloxicam": 1150345, "valsartan": 1308842,
    "acetaminophen": 1125315, "naproxen": 1115008, "lithium": 19124477,
    "celecoxib": 1118084, "diclofenac": 1124300, "warfarin": 1310149,
}
ACE_INHIBITORS = (1342439, 1334456, 1331235, 1373225, 1310756, 1308216, 1363749, 1341927, 1340128, 1335471)
ATRIAL_FIBRILLATION = 313217
STROKE_ANCESTORS = (443454,)
STROKE_EXTRA = (441874, 375557, 372924)
ANGIOEDEMA = 432791
TYPE_2_DIABETES = 201826
INPATIENT_VISITS = (9201, 38004311, 8920, 262)
MALE, FEMALE = 8507, 8532

# --- Fixed values: signal queries ------------------------------------------
LIVER_SIGNAL_DRUGS = (
    "azilsartan", "candesartan", "eprosartan", "fimasartan", "irbesartan", "olmesartan", "telmisartan", "valsartan",
)
LIVER_SIGNAL_PRIOR = ("K25", "K26", "K27", "B15", "B16", "B17", "B18", "B19", "E84", "E20", "E21")
LIVER_SIGNAL_OUTCOME = ("K70", "K71", "K72", "K73", "K74", "K75", "K76", "K77")
KIDNEY_SIGNAL_DRUGS = (
    "acetaminophen", "amphotericin b", "vancomycin", "cisplatin", "acyclovir", "foscarnet", "lithium",
    "ibuprofen", "diclofenac", "naproxen", "ketoprofen", "piroxicam",
)
KIDNEY_SIGNAL_PRIOR = (
    "K25", "K26", "K27", "K260", "K262", "K264", "K270", "K272", "K274", "K276", "K280", "K282", "K284", "K286",
    "K290", "K625", "K922", "I20", "I60", "I61", "I62", "I63",
)
KIDNEY_SIGNAL_OUTCOME = ("N0", "N1")

# --- Fixed values: condition grouping ---------------------------------------
CLINICAL_FINDING = 441840
EXTRA_CONDITION_GROUPS = (
    433736, 433595, 441408, 72404, 192671, 137977, 434621, 437312, 439847, 4171917, 438555, 4299449, 375258, 76784,
    40483532, 4145627, 434157, 433778, 258449, 313878,
)
UNSPECIFIC_GROUP_NAMES = (
    "%finding", "Disorder of%", "Finding of%", "Disease of%", "Injury of%", "%by site", "%by body site",
    "%by mechanism", "%of body region", "%of anatomical site", "%of specific body structure%",
)
ATC_CODE_LENGTHS = (1, 3, 4, 5)

# --- Fixed values: comorbidity scores (category, name, weight, ancestors) ---
CHARLSON = (
    (1, "Myocardial infarction", 1, (4329847,)),
    (2, "Congestive heart failure", 1, (316139,)),
    (3, "Peripheral vascular disease", 1, (321052,)),
    (4, "Cerebrovascular disease", 1, (381591, 434056)),
    (5, "Dementia", 1, (4182210,)),
    (6, "Chronic pulmonary disease", 1, (4063381,)),
    (7, "Rheumatologic disease", 1, (257628, 134442, 80800, 80809, 256197, 255348)),
    (8, "Peptic ulcer disease", 1, (4247120,)),
    (9, "Mild liver disease", 1, (4064161, 4212540)),
    (10, "Diabetes (mild to moderate)", 1, (201820,)),
    (11, "Diabetes with chronic complications", 2, (443767, 442793)),
    (12, "Hemiplegia or paraplegia", 2, (192606, 374022)),
    (13, "Renal disease", 2, (4030518,)),
    (14, "Any malignancy", 2, (443392,)),
    (15, "Moderate to severe liver disease", 3, (4245975, 4029488, 192680, 24966)),
    (16, "Metastatic solid tumor", 6, (432851,)),
    (17, "AIDS", 6, (439727,)),
)
CHADS2 = (
    (1, "Congestive heart failure", 1, (316139,)),
    (2, "Hypertension", 1, (316866,)),
    (4, "Diabetes", 1, (201820,)),
    (5, "Stroke", 2, (381591, 434056)),
)
# (category, name, weight, ancestors, excluded ancestors, extra single concepts)
CHADS2VASC = (
    (1, "Congestive heart failure", 1, (316139, 314378), (), (316139, 314378, 318773, 321319)),
    (2, "Hypertension", 1, (320128, 442604, 201313), (197930,), ()),
    (4, "Diabetes", 1, (201820, 442793), (195771, 376112, 4174977, 4058243, 193323, 376979), ()),
    (5, "Stroke", 2,
     (4043731, 4110192, 375557, 4108356, 373503, 434656, 433505, 376714, 312337), (), ()),
    (6, "Vascular disease", 1,
     (312327, 43020432, 314962, 312939, 315288, 317309, 134380, 196438, 200138, 194393, 319047, 40486130, 317003,
      4313767, 321596), (),
     (312327, 43020432, 314962, 312939, 315288, 317309, 134380, 196438, 200138, 194393, 319047, 40486130, 317003,
      4313767, 321596, 317305, 321886, 314659, 321887, 437312, 134057)),
)
# Diabetes complications, (category, score, code prefixes, exact codes, (low, high) code range)
DCSI = (
    ("Retinopathy", 1, ("250.5",), ("362.01", "362.1", "362.83", "362.53", "362.81", "362.82"), None),
    ("Retinopathy", 2, ("361", "369"), ("362.02", "379.23"), None),
    ("Nephropathy", 1, ("580", "581", "582", "583"), ("250.4",), None),
    ("Nephropathy", 2, ("585", "586", "593.9"), (), None),
    ("Neuropathy", 1,
     ("356.9", "250.6", "358.1", "951.0", "951.1", "951.3", "713.5", "357.2", "337.0", "337.1", "564.5", "536.3",
      "458.0"), ("596.54",), ("354.0", "355.99")),
    ("Cerebrovascular", 1, ("435",), (), None),
    ("Cerebrovascular", 2, ("431", "433", "434", "436"), (), None),
    ("Cardiovascular", 1, ("440", "411", "413", "414", "429.2"), (), None),
    ("Cardiovascular", 2, ("410", "427.1", "427.3", "427.4", "427.5", "412", "428", "441"), ("440.23", "440.24"), None),
    ("Peripheral vascular disease", 1, ("250.7", "442.3", "892.1", "443.9"), ("443.81",), None),
    ("Peripheral vascular disease", 2, ("785.4", "707.1", "040.0"), ("444.22",), None),
    ("Metabolic", 2, ("250.1", "250.2", "250.3"), (), None),
)
# Hospital frailty, score of each three-character code prefix.
HFRS = (
    ("F00", 7.1), ("G81", 4.4), ("G30", 4.0), ("I69", 3.7), ("R29", 3.6), ("N39", 3.2), ("F05", 3.2), ("W19", 3.2),
    ("S00", 3.2), ("R31", 3.0), ("B96", 2.9), ("R41", 2.7), ("R26", 2.6), ("I67", 2.6), ("R56", 2.6), ("R40", 2.5),
    ("T83", 2.4), ("S06", 2.5), ("S42", 2.3), ("E87", 2.3), ("M25", 2.3), ("E86", 2.3), ("R54", 2.2), ("Z50", 2.1),
    ("F03", 2.1), ("W18", 2.1), ("Z75", 2.0), ("F01", 2.0), ("S80", 2.0), ("L03", 2.0), ("H54", 1.9), ("E53", 1.9),
    ("Z60", 1.8), ("G20", 1.8), ("R55", 1.8), ("S22", 1.8), ("K59", 1.8), ("N17", 1.8), ("L89", 1.7), ("Z22", 1.7),
    ("B95", 1.7), ("L97", 1.6), ("R44", 1.6), ("K26", 1.6), ("I95", 1.6), ("N19", 1.6), ("A41", 1.6), ("Z87", 1.5),
    ("J96", 1.5), ("X59", 1.5), ("M19", 1.5), ("G40", 1.5), ("M81", 1.4), ("S72", 1.4), ("S32", 1.4), ("E16", 1.4),
    ("R94", 1.4), ("N18", 1.4), ("R33", 1.3), ("R69", 1.3), ("N28", 1.3), ("R32", 1.2), ("G31", 1.2), ("Y95", 1.2),
    ("S09", 1.2), ("R45", 1.2), ("G45", 1.2), ("Z74", 1.1), ("M79", 1.1), ("W06", 1.1), ("S01", 1.1), ("A04", 1.1),
    ("A09", 1.1), ("J18", 1.1), ("J69", 1.0), ("R47", 1.0), ("E55", 1.0), ("Z93", 1.0), ("R02", 1.0), ("R63", 0.9),
    ("H91", 0.9), ("W10", 0.9), ("W01", 0.9), ("E05", 0.9), ("M41", 0.9), ("R13", 0.8), ("Z99", 0.8), ("U80", 0.8),
    ("M80", 0.8), ("K92", 0.8), ("I63", 0.8), ("N20", 0.7), ("F10", 0.7), ("Y84", 0.7), ("R00", 0.7), ("J22", 0.7),
    ("Z73", 0.6), ("R79", 0.6), ("Z91", 0.5), ("S51", 0.5), ("F32", 0.5), ("M48", 0.5), ("E83", 0.4), ("M15", 0.4),
    ("D64", 0.4), ("L08", 0.4), ("R11", 0.3), ("K52", 0.3), ("R50", 0.1),
)

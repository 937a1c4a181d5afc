"""Tables that must equal those of the data's sources, in their natural order."""

from __future__ import annotations

#: Names of relationship types of RF2 releases.
RELATIONSHIPS = {
    "116680003": "IS_A", "363698007": "FINDING_SITE", "116676008": "ASSOCIATED_MORPHOLOGY", "260686004": "METHOD", "363714003": "INTERPRETS", "405813007": "PROCEDURE_SITE_DIRECT",
    "370135005": "PATHOLOGICAL_PROCESS", "272741003": "LATERALITY", "246454002": "OCCURRENCE", "127489000": "HAS_ACTIVE_INGREDIENT", "42752001": "DUE_TO", "363713009": "HAS_INTERPRETATION",
    "246075003": "CAUSATIVE_AGENT", "411116001": "HAS_DOSE_FORM", "762949000": "HAS_PRECISE_ACTIVE_INGREDIENT", "732943007": "HAS_BASIS_OF_STRENGTH_SUBSTANCE", "363700003": "DIRECT_MORPHOLOGY",
    "405815000": "PROCEDURE_SITE_INDIRECT", "363704007": "PROCEDURE_SITE", "260870009": "PRIORITY", "363710007": "INDIRECT_MORPHOLOGY", "704319004": "INHERES_IN", "704318007": "PROPERTY_TYPE",
    "704327008": "DIRECT_DEVICE", "371881003": "DURING", "704326004": "PRECONDITION", "246112005": "SEVERITY", "263502005": "CLINICAL_COURSE", "47429007": "ASSOCIATED_WITH", "255234002": "AFTER",
    "363705008": "HAS_DEFINITIONAL_MANIFESTATION", "370130000": "PROPERTY", "370132008": "SCALE_TYPE", "370134009": "TIME_ASPECT", "246093002": "COMPONENT", "704321009": "CHARACTERIZES",
    "718497002": "INHERENT_LOCATION",
}

#: Term types of drugs, and types of their links.
DRUG_TYPES = ["IN", "PIN", "MIN", "BN", "SCD", "SBD", "SCDC", "SBDC", "SCDF", "SBDF", "SY", "TMSY", "PSN"]
DRUG_LINKS = [
    "has_ingredient", "ingredient_of", "has_tradename", "tradename_of", "has_dose_form", "dose_form_of", "consists_of", "constitutes", "has_precise_ingredient", "precise_ingredient_of",
    "isa", "inverse_isa", "has_quantified_form", "quantified_form_of", "has_form", "form_of", "contains", "contained_in",
]

#: Class of a hospital by its type.
FACILITIES = {
    "Acute Care Hospitals": "IPPS", "Critical Access Hospitals": "CAH", "Psychiatric": "PSYCH", "Childrens": "PEDS", "Acute Care - Veterans Administration": "VA",
    "Acute Care - Department of Defense": "DOD", "Rural Emergency Hospital": "REH", "Long-term": "LTCH", "PPS-Exempt Cancer Hospital": "PCH",
}

#: Abbreviations expanded before terms are compared.
EXPANSIONS = {
    "wbc": "white blood cell count", "rbc": "red blood cell count", "hgb": "hemoglobin", "hct": "hematocrit", "plt": "platelet count", "bun": "blood urea nitrogen", "cr": "creatinine",
    "ef": "ejection fraction", "inr": "international normalized ratio", "pt": "prothrombin time", "ptt": "partial thromboplastin time", "esr": "erythrocyte sedimentation rate",
    "crp": "c-reactive protein", "bnp": "brain natriuretic peptide", "tsh": "thyroid stimulating hormone", "psa": "prostate specific antigen", "hba1c": "hemoglobin a1c", "a1c": "hemoglobin a1c",
    "ast": "aspartate aminotransferase", "alt": "alanine aminotransferase", "alp": "alkaline phosphatase", "lad": "left anterior descending coronary artery", "rca": "right coronary artery",
    "lcx": "left circumflex coronary artery", "lv": "left ventricle", "rv": "right ventricle", "la": "left atrium", "ra": "right atrium", "lvef": "left ventricular ejection fraction",
    "rlq": "right lower quadrant of abdomen", "ruq": "right upper quadrant of abdomen", "llq": "left lower quadrant of abdomen", "luq": "left upper quadrant of abdomen",
}

#: Names of laboratory tests and units, for a value such as "glucose of 250 mg/dL".
LABS = [
    "WBC", "RBC", "Hgb", "Hct", "PLT", "BUN", "Cr", "glucose", "HbA1c", "A1c", "Na", "K", "Cl", "CO2", "Ca", "Mg", "albumin", "AST", "ALT", "ALP", "bilirubin", "TSH", "T4", "PSA", "INR",
    "PT", "PTT", "ESR", "CRP", "troponin", "BNP", "lactate", "lipase", "amylase",
]
UNITS = ["%", "mg/dL", "g/dL", "mEq/L", "mmol/L", "U/L", "ng/mL", "cells/mcL", "K/uL", "sec", "mIU/L"]

#: Names of medications.
MEDICATIONS = [
    "metformin", "insulin", "lisinopril", "amlodipine", "atorvastatin", "omeprazole", "pantoprazole", "metoprolol", "losartan", "gabapentin", "levothyroxine", "prednisone", "amoxicillin",
    "azithromycin", "ciprofloxacin", "ibuprofen", "acetaminophen", "aspirin", "warfarin", "heparin", "enoxaparin", "furosemide", "hydrochlorothiazide", "albuterol", "fluticasone", "montelukast",
    "sertraline", "fluoxetine", "escitalopram", "duloxetine", "tramadol", "oxycodone", "morphine", "hydrocodone", "clopidogrel", "apixaban", "rivaroxaban",
]

#: Abbreviations of conditions in notes.
CONDITION_SHORT = {
    "rlq": "right lower quadrant", "ruq": "right upper quadrant", "llq": "left lower quadrant", "luq": "left upper quadrant", "sob": "shortness of breath", "cp": "chest pain", "ha": "headache",
    "htn": "hypertension", "dm": "diabetes mellitus", "cad": "coronary artery disease", "chf": "congestive heart failure", "copd": "chronic obstructive pulmonary disease",
    "uti": "urinary tract infection", "bph": "benign prostatic hyperplasia", "gerd": "gastroesophageal reflux disease", "ckd": "chronic kidney disease", "dvt": "deep vein thrombosis",
    "pe": "pulmonary embolism", "mi": "myocardial infarction", "cva": "cerebrovascular accident", "tia": "transient ischemic attack",
}

#: Terms of notes by category.
NOTE_TERMS = {
    "condition": [
        "appendicitis", "pneumonia", "diabetes", "diabetes mellitus", "type 2 diabetes", "type 1 diabetes", "hypertension", "heart failure", "atrial fibrillation", "myocardial infarction", "stroke",
        "asthma", "cellulitis", "sepsis", "fracture", "abscess", "cholecystitis", "diverticulitis", "pancreatitis", "urinary tract infection", "kidney disease",
    ],
    "symptom": [
        "pain", "abdominal pain", "chest pain", "headache", "fever", "nausea", "vomiting", "diarrhea", "cough", "shortness of breath", "dizziness", "fatigue", "swelling", "tenderness",
        "rebound tenderness", "guarding", "edema", "rash", "dyspnea", "tachycardia", "hypotension", "chills", "weight loss", "weight gain", "inflammation",
    ],
    "body_site": ["abdomen", "appendix", "chest", "lung", "heart", "liver", "kidney", "gallbladder", "pancreas", "colon"],
}
QUALIFIERS = ["acute", "chronic", "mild", "moderate", "severe", "bilateral", "recurrent"]
NEGATION = r"(?:no|denies|denied|negative for|without|absent|not|non)[- ]"

#: Patterns of procedures.
PROCEDURES = {
    r"\bappendectomy\b": "appendectomy", r"\bcholecystectomy\b": "cholecystectomy", r"\bcolonoscopy\b": "colonoscopy", r"\bendoscopy\b": "endoscopy",
    r"\bct\s+(?:scan\s+)?(?:of\s+)?(?:the\s+)?(\w+)": "CT scan", r"\bmri\s+(?:of\s+)?(?:the\s+)?(\w+)": "MRI", r"\bx-?ray\b": "X-ray", r"\bultrasound\b": "ultrasound", r"\bbiopsy\b": "biopsy",
    r"\bintubation\b": "intubation", r"\bcabg\b": "coronary artery bypass graft", r"\bangioplasty\b": "angioplasty", r"\bdialysis\b": "dialysis", r"\btransfusion\b": "transfusion",
}

#: Fields of the hospital directory, the provider file and the provider by DRG file: name there -> (name here, kind).
HOSPITAL_FIELDS = {
    "Facility ID": ("ccn", "str"), "Facility Name": ("name", "str"), "Address": ("address", "str"), "City/Town": ("city", "str"), "State": ("state", "str"), "ZIP Code": ("zip", "str"),
    "County/Parish": ("county", "str"), "Telephone Number": ("phone", "str"), "Hospital Type": ("hospital_type", "str"), "Hospital Ownership": ("ownership", "str"),
    "Emergency Services": ("emergency_services", "bool"), "Meets criteria for birthing friendly designation": ("birthing_friendly", "bool"), "Hospital overall rating": ("overall_rating", "int"),
    "Count of Facility MORT Measures": ("mort_measures_count", "int"), "Count of MORT Measures Better": ("mort_better", "int"), "Count of MORT Measures Worse": ("mort_worse", "int"),
    "Count of Facility Safety Measures": ("safety_measures_count", "int"), "Count of Safety Measures Better": ("safety_better", "int"), "Count of Safety Measures Worse": ("safety_worse", "int"),
    "Count of Facility READM Measures": ("readm_measures_count", "int"), "Count of READM Measures Better": ("readm_better", "int"), "Count of READM Measures Worse": ("readm_worse", "int"),
    "Count of Facility Pt Exp Measures": ("ptexp_measures_count", "int"), "Count of Facility TE Measures": ("te_measures_count", "int"),
}
PROVIDER_FIELDS = {
    "Rndrng_Prvdr_CCN": ("ccn", "str"), "Tot_Benes": ("total_beneficiaries", "int"), "Tot_Dschrgs": ("total_discharges", "int"), "Tot_Submtd_Cvrd_Chrg": ("total_covered_charges", "float"),
    "Tot_Pymt_Amt": ("total_payment", "float"), "Tot_Mdcr_Pymt_Amt": ("total_medicare_payment", "float"), "Tot_Cvrd_Days": ("total_covered_days", "int"), "Tot_Days": ("total_days", "int"),
    "Bene_Avg_Age": ("avg_beneficiary_age", "float"), "Bene_Avg_Risk_Scre": ("avg_risk_score", "float"), "Bene_CC_PH_HF_NonIHD_V2_Pct": ("pct_heart_failure", "float"),
    "Bene_CC_PH_Diabetes_V2_Pct": ("pct_diabetes", "float"), "Bene_CC_PH_CKD_V2_Pct": ("pct_ckd", "float"), "Bene_CC_PH_COPD_V2_Pct": ("pct_copd", "float"),
    "Bene_CC_BH_Depress_V1_Pct": ("pct_depression", "float"), "Bene_CC_PH_Afib_V2_Pct": ("pct_afib", "float"), "Bene_CC_PH_Stroke_TIA_V2_Pct": ("pct_stroke", "float"),
}
SERVICE_FIELDS = {
    "Rndrng_Prvdr_CCN": ("ccn", "str"), "DRG_Cd": ("drg", "whole"), "DRG_Desc": ("drg_description", "str"), "Tot_Dschrgs": ("discharges", "int"), "Avg_Submtd_Cvrd_Chrg": ("avg_covered_charges", "float"),
    "Avg_Tot_Pymt_Amt": ("avg_total_payment", "float"), "Avg_Mdcr_Pymt_Amt": ("avg_medicare_payment", "float"),
}

"""Fixed vocabularies of the report domain: conditions, patterns, regions, phrases.

All of these are parameters of the operators; the values below are the defaults.
"""

from __future__ import annotations

# The 18 conditions in label order.
LABELS = [
    "Medical material", "Arterial wall calcification", "Cardiomegaly", "Pericardial effusion",
    "Coronary artery wall calcification", "Hiatal hernia", "Lymphadenopathy", "Emphysema", "Atelectasis", "Lung nodule",
    "Lung opacity", "Pulmonary fibrotic sequela", "Pleural effusion", "Mosaic attenuation pattern",
    "Peribronchial thickening", "Consolidation", "Bronchiectasis", "Interlobular septal thickening",
]

# Patterns by which a sentence mentions a condition.
SYNONYMS = {
    "Medical material": [r"\bsurgical clip", r"\bstent\b", r"\bcatheter\b", r"\bport\b", r"\bimplant", r"\bprosthe", r"\bforeign body", r"\bsuture", r"\bmesh\b", r"\bplate\b", r"\bscrew", r"\bwire\b", r"\bline\b", r"\btube\b", r"\bdrain\b", r"\bmedical material", r"\bmetallic\b", r"\bendotracheal tube", r"\btracheostomy", r"\bmarker\b", r"\bsurgical material"],
    "Arterial wall calcification": [r"arterial.{0,12}calcification", r"aortic.{0,12}calcification", r"vessel wall.{0,12}calcification", r"mural.{0,12}calcification", r"calcified.{0,15}athero", r"atheromatous.{0,15}calcif", r"calcified plaque", r"intimal.{0,12}calcif", r"\batherosclerot", r"calcific.{0,8}atherom"],
    "Cardiomegaly": [r"cardiomegaly", r"enlarged heart", r"cardiac enlargement", r"increased.{0,10}heart.{0,10}size", r"heart.{0,5}enlarg", r"cardiothoracic ratio", r"globular heart", r"increased.{0,5}cardiac"],
    "Pericardial effusion": [r"pericardial.{0,15}effusion", r"effusion.{0,15}pericardi", r"fluid.{0,15}pericardi", r"pericardial.{0,8}fluid", r"pericardial.{0,8}thicken"],
    "Coronary artery wall calcification": [r"coronary.{0,20}calcification", r"calcified.{0,15}coronary", r"\bcac\b", r"coronary.{0,8}calcium", r"calcium.{0,8}corona"],
    "Hiatal hernia": [r"hiatal hernia", r"hiatus hernia", r"axial.{0,8}hernia", r"sliding.{0,8}hernia"],
    "Lymphadenopathy": [r"lymphadenopathy", r"lymph.{0,10}node.{0,15}enlarg", r"enlarg.{0,10}lymph.{0,10}node", r"\blap\b", r"pathological.{0,5}lap", r"pathological.{0,15}lymph", r"\badenopathy\b", r"shotty lymph", r"lymph node.{0,15}measur"],
    "Emphysema": [r"emphysema", r"emphysematous", r"centrilobular", r"paraseptal", r"\bbulla[e]?\b", r"\bbullous\b"],
    "Atelectasis": [r"atelectas[ie]s", r"atelectatic", r"lung collapse", r"collapsed.{0,15}lung", r"platelike", r"plate-like", r"subsegmental.{0,8}collapse", r"linear.{0,8}atelect"],
    "Lung nodule": [r"\bnodule", r"\bnodular", r"subcentimeter.{0,8}nodul", r"noncalcified nodul", r"nodular density"],
    "Lung opacity": [r"\bopacit", r"ground.{0,3}glass", r"\bgg[on]\b", r"opacification", r"infiltrat", r"\bhazy\b", r"\bpatchy\b", r"airspace.{0,8}disease"],
    "Pulmonary fibrotic sequela": [r"fibrosis", r"fibrotic", r"\bscar", r"honeycomb", r"traction.{0,5}bronchi", r"reticular.{0,8}opacit", r"fibrocavitary"],
    "Pleural effusion": [r"pleural.{0,15}effusion", r"effusion.{0,15}pleura", r"fluid.{0,10}pleural", r"pleural.{0,8}thicken.{0,8}effusion", r"thickening-effusion"],
    "Mosaic attenuation pattern": [r"mosaic", r"air trapping"],
    "Peribronchial thickening": [r"peribronchial.{0,15}thicken", r"peribronchial.{0,15}cuff", r"peribronchovascular", r"bronchial.{0,5}wall.{0,5}thicken"],
    "Consolidation": [r"consolidation", r"consolidative", r"consolidated", r"lobar.{0,5}consolidat"],
    "Bronchiectasis": [r"bronchiectas[ie]s", r"bronchiectatic", r"varicose.{0,5}bronchi", r"cystic.{0,5}bronchi"],
    "Interlobular septal thickening": [r"septal.{0,10}thicken", r"interlobular.{0,10}septa", r"kerley.{0,5}line", r"smooth.{0,5}septal"],
}

# Cues that negate the whole sentence.
NEGATIONS = [
    r"\bno\b", r"\bnot\b", r"\bn[''`]t\b", r"\bwithout\b", r"\babsent\b", r"\bnegative for\b", r"\bno evidence of\b", r"\bno significant\b",
    r"\bno acute\b", r"\bnot detected\b", r"\bnot observed\b", r"\bnot identified\b", r"\bnot seen\b", r"\bnot present\b", r"\bdoes not\b",
    r"\bdid not\b", r"\bdenied\b", r"\bdenies\b", r"\bunremarkable\b", r"\bwithin normal\b", r"\bare normal\b", r"\bis normal\b",
    r"\bare natural\b", r"\bis natural\b", r"\bfree of\b", r"\bruled out\b", r"\bdemonstrated no\b", r"\bwithout identifiable\b",
    r"\bappears? normal\b", r"\bappears? preserved\b", r"\bis preserved\b", r"\bare preserved\b", r"\bwithout evidence\b",
    r"\bno acute findings\b", r"\bare patent\b", r"\bis patent\b", r"\bno definite\b", r"\bno overt\b",
]

# The region of each condition, the order of regions, the stock phrase of a region.
REGION = {
    "Medical material": "general", "Arterial wall calcification": "mediastinum", "Cardiomegaly": "heart", "Pericardial effusion": "heart",
    "Coronary artery wall calcification": "heart", "Hiatal hernia": "esophagus", "Lymphadenopathy": "mediastinum", "Emphysema": "lung",
    "Atelectasis": "lung", "Lung nodule": "lung", "Lung opacity": "lung", "Pulmonary fibrotic sequela": "lung", "Pleural effusion": "pleura",
    "Mosaic attenuation pattern": "lung", "Peribronchial thickening": "lung", "Consolidation": "lung", "Bronchiectasis": "lung",
    "Interlobular septal thickening": "lung",
}
REGIONS = ["abdomen", "bone structures", "esophagus", "heart", "lung", "mediastinum", "pleura", "trachea and bronchie", "general"]
STOCK = {
    "abdomen": ["Upper abdominal organs included in the sections are normal."],
    "bone structures": ["Bone structures in the study area are natural."],
    "esophagus": ["Thoracic esophagus calibration was normal and no significant tumoral wall thickening was detected."],
    "trachea and bronchie": ["Trachea and both main bronchi are open."],
    "mediastinum": ["No enlarged lymph nodes in prevascular, pre-paratracheal, subcarinal or bilateral hilar-axillary pathological dimensions."],
    "heart": ["Heart contour and size are normal."],
}

# The phrases whose frequency is audited.
AUDITED = {
    "abdomen": "No significant pathology was detected in the abdominal sections.",
    "bone structures": "Bone structures in the study area are natural.",
    "esophagus": "Thoracic esophagus calibration is normal.",
    "trachea and bronchie": "Trachea and main bronchi are open.",
    "mediastinum": "No enlarged lymph nodes in pathological dimensions.",
    "heart": "Heart contour and size are normal.",
}

# Patterns of measurements and of places.
MEASUREMENT = r"\b\d+(?:\.\d+)?\s*(?:mm|cm)\b|\b\d+\s*[x×]\s*\d+\b"
LOCATION = (
    r"\b(lobe|segment|left|right|upper|middle|lower|anterior|posterior|both|bilateral|hemithorax|paracardiac|mediastinal|hilar|axillary|"
    r"prevascular|paratracheal|subcarinal|peribronchial|pleural|abdominal|vertebral|lumbar|thoracic)\b"
)

# Conditions by prevalence with the labels of table rows.
PREVALENCE = [
    ("High prevalence", [("Arterial wall calcification", r"Arterial wall calc."), ("Coronary artery wall calcification", r"Coronary art.\ calc."), ("Lung opacity", "Lung opacity"), ("Lung nodule", "Lung nodule"), ("Cardiomegaly", "Cardiomegaly"), ("Pleural effusion", "Pleural effusion")]),
    ("Medium prevalence", [("Consolidation", "Consolidation"), ("Emphysema", "Emphysema"), ("Atelectasis", "Atelectasis"), ("Pulmonary fibrotic sequela", r"Pulm.\ fibrotic seq."), ("Mosaic attenuation pattern", r"Mosaic atten.\ patt."), ("Lymphadenopathy", "Lymphadenopathy")]),
    ("Low prevalence", [("Interlobular septal thickening", r"Interlob.\ sept.\ th."), ("Hiatal hernia", "Hiatal hernia"), ("Bronchiectasis", "Bronchiectasis"), ("Medical material", "Medical material"), ("Peribronchial thickening", "Peribronchial th."), ("Pericardial effusion", "Pericardial effusion")]),
]

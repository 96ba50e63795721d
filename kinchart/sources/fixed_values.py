"""The word lists, code tables and display texts the engine works with.

Everything in this module is data that has to equal the published tables for results to be right.
One entry per line, ``key = value [= value ...]``, in natural order; the line number becomes the
``ord`` column of the matching dimension (see ``dimensions.py``), which is what decides every
"first match wins" rule.  All tables have fewer than 200 rows, so a broadcast of any of them has a
size bound that does not depend on the data.
"""

# Condition name = ICD-10 code.
CONDITIONS = """
type 2 diabetes = E11
type 2 diabetes mellitus = E11
diabetes mellitus = E11
diabetes = E11
type 1 diabetes = E10
gestational diabetes = O24
hypothyroidism = E03.9
hyperthyroidism = E05.9
graves disease = E05.0
hashimoto thyroiditis = E06.3
thyroiditis = E06.9
goitre = E04.9
obesity = E66
overweight = E66.01
hyperlipidemia = E78.5
hypercholesterolemia = E78.0
hypertriglyceridemia = E78.1
metabolic syndrome = E88.81
vitamin d deficiency = E55.9
vitamin b12 deficiency = E53.8
iron deficiency anaemia = D50.9
anaemia = D64.9
anemia = D64.9
gout = M10.9
hyperuricemia = E79.0
hypertension = I10
essential hypertension = I10
high blood pressure = I10
coronary artery disease = I25.1
ischemic heart disease = I25.9
angina = I20.9
unstable angina = I20.0
myocardial infarction = I21.9
heart attack = I21.9
heart failure = I50.9
congestive heart failure = I50.0
atrial fibrillation = I48.0
arrhythmia = I49.9
stroke = I63.9
tia = G45.9
transient ischemic attack = G45.9
deep vein thrombosis = I82.4
dvt = I82.4
pulmonary embolism = I26.99
cardiomyopathy = I42.9
mitral valve disease = I05.9
aortic stenosis = I35.0
peripheral artery disease = I73.9
asthma = J45.9
copd = J44.1
chronic obstructive pulmonary disease = J44.1
pneumonia = J18.9
tuberculosis = A15.9
tb = A15.9
pulmonary tuberculosis = A15.0
pleural effusion = J90
bronchitis = J40
chronic bronchitis = J42
sleep apnea = G47.3
obstructive sleep apnea = G47.33
interstitial lung disease = J84.9
pulmonary fibrosis = J84.10
rhinitis = J30.9
sinusitis = J32.9
gastroesophageal reflux = K21.9
gerd = K21.9
acid reflux = K21.9
peptic ulcer = K27.9
gastric ulcer = K25.9
duodenal ulcer = K26.9
irritable bowel syndrome = K58.9
ibs = K58.9
crohn disease = K50.9
ulcerative colitis = K51.9
celiac disease = K90.0
constipation = K59.0
diarrhea = R19.7
hepatitis b = B18.1
hepatitis c = B18.2
cirrhosis = K74.6
fatty liver = K76.0
nafld = K76.0
gallstones = K80.2
cholecystitis = K81.9
pancreatitis = K85.9
appendicitis = K37
hernia = K46.9
haemorrhoids = K64.9
hemorrhoids = K64.9
epilepsy = G40.9
migraine = G43.9
tension headache = G44.2
parkinson disease = G20
alzheimer disease = G30.9
dementia = F03.9
multiple sclerosis = G35
neuropathy = G60.9
peripheral neuropathy = G60.9
carpal tunnel syndrome = G56.0
vertigo = R42
benign positional vertigo = H81.1
bells palsy = G51.0
depression = F32.9
major depressive disorder = F33.9
anxiety = F41.9
generalized anxiety disorder = F41.1
panic disorder = F41.0
bipolar disorder = F31.9
schizophrenia = F20.9
ocd = F42.9
obsessive compulsive disorder = F42.9
ptsd = F43.1
adhd = F90.9
insomnia = G47.00
osteoarthritis = M19.9
rheumatoid arthritis = M06.9
arthritis = M13.9
osteoporosis = M81.0
ankylosing spondylitis = M45.9
fibromyalgia = M79.7
lumbar disc disease = M51.1
back pain = M54.5
neck pain = M54.2
spondylosis = M47.9
tendinitis = M77.9
bursitis = M71.9
frozen shoulder = M75.0
rotator cuff tear = M75.1
chronic kidney disease = N18.9
ckd = N18.9
acute kidney injury = N17.9
nephrotic syndrome = N04.9
urinary tract infection = N39.0
uti = N39.0
kidney stones = N20.0
kidney stone = N20.0
renal calculus = N20.0
renal calculi = N20.0
renal stone = N20.0
ureteric calculus = N20.1
ureteric stone = N20.1
calculus = N20.0
nephrolithiasis = N20.0
benign prostatic hyperplasia = N40.0
bph = N40.0
prostate cancer = C61
urinary incontinence = R32
polycystic ovarian syndrome = E28.2
pcos = E28.2
endometriosis = N80.9
uterine fibroids = D25.9
menorrhagia = N92.0
dysmenorrhea = N94.6
menopause = N95.1
cervical cancer = C53.9
breast cancer = C50.9
ovarian cancer = C56.9
eczema = L30.9
atopic dermatitis = L20.9
psoriasis = L40.9
urticaria = L50.9
acne = L70.9
rosacea = L71.9
vitiligo = L80
alopecia = L65.9
covid-19 = U07.1
influenza = J11.1
dengue = A90
malaria = B54
typhoid = A01.0
chickenpox = B01.9
herpes zoster = B02.9
hiv = B20
lung cancer = C34.9
colorectal cancer = C19
gastric cancer = C16.9
liver cancer = C22.9
pancreatic cancer = C25.9
leukemia = C95.9
lymphoma = C85.9
thyroid cancer = C73
glaucoma = H40.9
cataract = H26.9
diabetic retinopathy = H36.0
macular degeneration = H35.3
hearing loss = H91.9
tinnitus = H93.1
otitis media = H66.9
"""

# Drug name = ATC code = generic name = drug class.
DRUGS = """
metformin = A10BA02 = Metformin = Biguanide
glibenclamide = A10BB01 = Glibenclamide = Sulfonylurea
glipizide = A10BB07 = Glipizide = Sulfonylurea
gliclazide = A10BB09 = Gliclazide = Sulfonylurea
glimepiride = A10BB12 = Glimepiride = Sulfonylurea
pioglitazone = A10BG03 = Pioglitazone = Thiazolidinedione
sitagliptin = A10BH01 = Sitagliptin = DPP-4 inhibitor
vildagliptin = A10BH02 = Vildagliptin = DPP-4 inhibitor
dapagliflozin = A10BK01 = Dapagliflozin = SGLT-2 inhibitor
empagliflozin = A10BK03 = Empagliflozin = SGLT-2 inhibitor
canagliflozin = A10BK02 = Canagliflozin = SGLT-2 inhibitor
liraglutide = A10BJ02 = Liraglutide = GLP-1 agonist
semaglutide = A10BJ06 = Semaglutide = GLP-1 agonist
insulin glargine = A10AE04 = Insulin glargine = Basal insulin
insulin detemir = A10AE05 = Insulin detemir = Basal insulin
human insulin = A10AB01 = Human insulin = Rapid insulin
levothyroxine = H03AA01 = Levothyroxine = Thyroid hormone
thyroxine = H03AA01 = Levothyroxine = Thyroid hormone
liothyronine = H03AA02 = Liothyronine = Thyroid hormone
carbimazole = H03BB01 = Carbimazole = Antithyroid
propylthiouracil = H03BA02 = Propylthiouracil = Antithyroid
amlodipine = C08CA01 = Amlodipine = Calcium channel blocker
nifedipine = C08CA05 = Nifedipine = Calcium channel blocker
enalapril = C09AA02 = Enalapril = ACE inhibitor
ramipril = C09AA05 = Ramipril = ACE inhibitor
lisinopril = C09AA03 = Lisinopril = ACE inhibitor
losartan = C09CA01 = Losartan = ARB
telmisartan = C09CA07 = Telmisartan = ARB
olmesartan = C09CA08 = Olmesartan = ARB
valsartan = C09CA03 = Valsartan = ARB
metoprolol = C07AB02 = Metoprolol = Beta blocker
atenolol = C07AB03 = Atenolol = Beta blocker
bisoprolol = C07AB07 = Bisoprolol = Beta blocker
carvedilol = C07AG02 = Carvedilol = Alpha-beta blocker
furosemide = C03CA01 = Furosemide = Loop diuretic
hydrochlorothiazide = C03AA03 = Hydrochlorothiazide = Thiazide diuretic
spironolactone = C03DA01 = Spironolactone = Potassium-sparing diuretic
clonidine = C02AC01 = Clonidine = Central alpha-2 agonist
prazosin = C02CA01 = Prazosin = Alpha-1 blocker
atorvastatin = C10AA05 = Atorvastatin = Statin
rosuvastatin = C10AA07 = Rosuvastatin = Statin
simvastatin = C10AA01 = Simvastatin = Statin
pitavastatin = C10AA08 = Pitavastatin = Statin
ezetimibe = C10AX09 = Ezetimibe = Cholesterol absorption inhibitor
fenofibrate = C10AB05 = Fenofibrate = Fibrate
aspirin = B01AC06 = Aspirin = Antiplatelet
clopidogrel = B01AC04 = Clopidogrel = Antiplatelet
warfarin = B01AA03 = Warfarin = Anticoagulant
rivaroxaban = B01AF01 = Rivaroxaban = NOAC
apixaban = B01AF02 = Apixaban = NOAC
dabigatran = B01AE07 = Dabigatran = NOAC
paracetamol = N02BE01 = Paracetamol = Analgesic/Antipyretic
acetaminophen = N02BE01 = Paracetamol = Analgesic/Antipyretic
ibuprofen = M01AE01 = Ibuprofen = NSAID
diclofenac = M01AB05 = Diclofenac = NSAID
naproxen = M01AE02 = Naproxen = NSAID
celecoxib = M01AH01 = Celecoxib = COX-2 inhibitor
tramadol = N02AX02 = Tramadol = Opioid analgesic
morphine = N02AA01 = Morphine = Opioid
amoxicillin = J01CA04 = Amoxicillin = Penicillin
amoxiclav = J01CR02 = Amoxicillin-Clavulanate = Penicillin+Beta-lactamase inhibitor
augmentin = J01CR02 = Amoxicillin-Clavulanate = Penicillin+Beta-lactamase inhibitor
azithromycin = J01FA10 = Azithromycin = Macrolide
clarithromycin = J01FA09 = Clarithromycin = Macrolide
doxycycline = J01AA02 = Doxycycline = Tetracycline
ciprofloxacin = J01MA02 = Ciprofloxacin = Fluoroquinolone
levofloxacin = J01MA12 = Levofloxacin = Fluoroquinolone
cefixime = J01DD08 = Cefixime = 3rd gen Cephalosporin
cefuroxime = J01DC02 = Cefuroxime = 2nd gen Cephalosporin
metronidazole = J01XD01 = Metronidazole = Nitroimidazole
clindamycin = J01FF01 = Clindamycin = Lincosamide
omeprazole = A02BC01 = Omeprazole = PPI
pantoprazole = A02BC02 = Pantoprazole = PPI
rabeprazole = A02BC04 = Rabeprazole = PPI
esomeprazole = A02BC05 = Esomeprazole = PPI
ranitidine = A02BA02 = Ranitidine = H2 blocker
domperidone = A03FA03 = Domperidone = Prokinetic
ondansetron = A04AA01 = Ondansetron = 5-HT3 antagonist
sertraline = N06AB06 = Sertraline = SSRI
fluoxetine = N06AB03 = Fluoxetine = SSRI
escitalopram = N06AB10 = Escitalopram = SSRI
paroxetine = N06AB05 = Paroxetine = SSRI
venlafaxine = N06AX16 = Venlafaxine = SNRI
duloxetine = N06AX21 = Duloxetine = SNRI
alprazolam = N05BA12 = Alprazolam = Benzodiazepine
clonazepam = N03AE01 = Clonazepam = Benzodiazepine
quetiapine = N05AH04 = Quetiapine = Atypical antipsychotic
olanzapine = N05AH03 = Olanzapine = Atypical antipsychotic
salbutamol = R03AC02 = Salbutamol = Short-acting beta-2 agonist
albuterol = R03AC02 = Salbutamol = Short-acting beta-2 agonist
salmeterol = R03AC12 = Salmeterol = Long-acting beta-2 agonist
formoterol = R03AC13 = Formoterol = Long-acting beta-2 agonist
budesonide = R03BA02 = Budesonide = Inhaled corticosteroid
fluticasone = R03BA05 = Fluticasone = Inhaled corticosteroid
tiotropium = R03BB04 = Tiotropium = Long-acting anticholinergic
montelukast = R03DC03 = Montelukast = Leukotriene receptor antagonist
cetirizine = R06AE07 = Cetirizine = Antihistamine
fexofenadine = R06AX26 = Fexofenadine = Antihistamine
loratadine = R06AX13 = Loratadine = Antihistamine
levodopa = N04BA01 = Levodopa = Dopamine precursor
carbidopa = N04BA02 = Carbidopa-Levodopa = Dopamine precursor
donepezil = N06DA02 = Donepezil = Cholinesterase inhibitor
phenytoin = N03AB02 = Phenytoin = Antiepileptic
valproate = N03AG01 = Valproate = Antiepileptic
levetiracetam = N03AX14 = Levetiracetam = Antiepileptic
gabapentin = N03AX12 = Gabapentin = Antiepileptic/Neuropathic
pregabalin = N03AX16 = Pregabalin = Antiepileptic/Neuropathic
sumatriptan = N02CC01 = Sumatriptan = Triptan
vitamin d3 = A11CC05 = Colecalciferol = Vitamin D
cholecalciferol = A11CC05 = Colecalciferol = Vitamin D
vitamin b12 = B03BA01 = Cyanocobalamin = Vitamin B12
methylcobalamin = B03BA51 = Methylcobalamin = Vitamin B12
folic acid = B03BB01 = Folic acid = Vitamin B9
ferrous sulphate = B03AA07 = Ferrous sulphate = Iron supplement
calcium carbonate = A12AA04 = Calcium carbonate = Calcium supplement
omega 3 = C10AX06 = Omega-3 fatty acids = Lipid modifier
prednisolone = H02AB06 = Prednisolone = Corticosteroid
prednisone = H02AB07 = Prednisone = Corticosteroid
dexamethasone = H02AB02 = Dexamethasone = Corticosteroid
methylprednisolone = H02AB04 = Methylprednisolone = Corticosteroid
hydrocortisone = H02AB09 = Hydrocortisone = Corticosteroid
tamsulosin = G04CA02 = Tamsulosin = Alpha-1 blocker
finasteride = G04CB01 = Finasteride = 5-alpha reductase inhibitor
sildenafil = G04BE03 = Sildenafil = PDE5 inhibitor
tadalafil = G04BE08 = Tadalafil = PDE5 inhibitor
"""

# Brand name = generic name.
BRANDS = """
glycomet = metformin
glucophage = metformin
januvia = sitagliptin
jardiance = empagliflozin
forxiga = dapagliflozin
victoza = liraglutide
ozempic = semaglutide
lantus = insulin glargine
synjardy = empagliflozin+metformin
thyronorm = levothyroxine
eltroxin = levothyroxine
thyrox = levothyroxine
stamlo = amlodipine
amlip = amlodipine
cardace = ramipril
covance = losartan
telma = telmisartan
minipress = prazosin
aten = atenolol
concor = bisoprolol
lasix = furosemide
aldactone = spironolactone
lipitor = atorvastatin
crestor = rosuvastatin
rozavel = rosuvastatin
storvas = atorvastatin
ecosprin = aspirin
deplatt = clopidogrel
xarelto = rivaroxaban
eliquis = apixaban
crocin = paracetamol
dolo = paracetamol
combiflam = ibuprofen+paracetamol
voveran = diclofenac
pan = pantoprazole
omez = omeprazole
pantocid = pantoprazole
nexium = esomeprazole
zantac = ranitidine
emeset = ondansetron
azee = azithromycin
zithromax = azithromycin
ciplox = ciprofloxacin
levoquin = levofloxacin
augmentin = amoxiclav
mox = amoxicillin
flagyl = metronidazole
zoloft = sertraline
prozac = fluoxetine
lexapro = escitalopram
cipralex = escitalopram
duzela = duloxetine
xanax = alprazolam
clonax = clonazepam
ventolin = salbutamol
asthalin = salbutamol
seretide = salmeterol+fluticasone
foracort = formoterol+budesonide
montek = montelukast
zyrtec = cetirizine
allegra = fexofenadine
dopaquel = quetiapine
encorate = valproate
gabapin = gabapentin
lyrica = pregabalin
calcirol = vitamin d3
revital = multivitamin
shelcal = calcium carbonate
wysolone = prednisolone
dexa = dexamethasone
floricot = hydrocortisone
urimax = tamsulosin
proscar = finasteride
"""

# Dosing term = standard phrase.
FREQUENCIES = """
od = Once daily
once daily = Once daily
once a day = Once daily
bd = Twice daily
bid = Twice daily
twice daily = Twice daily
twice a day = Twice daily
tds = Three times daily
tid = Three times daily
thrice daily = Three times daily
three times daily = Three times daily
qid = Four times daily
four times daily = Four times daily
sos = As needed
prn = As needed
as needed = As needed
hs = At bedtime
at bedtime = At bedtime
ac = Before meals
before meals = Before meals
pc = After meals
after meals = After meals
weekly = Once weekly
once weekly = Once weekly
monthly = Once monthly
"""

# Regular expression = replacement, applied in this order, ignoring case.
OCR_FIXES = r"""
\brnq\b = mg
\brnl\b = ml
\bmcq\b = mcg
\brneg\b = meg
\blU\b = IU
\b1U\b = IU
(?<!\d)0(?=\s*(?:mg|ml|mcg|IU|tablets?)) = O
\bO(?=\d) = 0
\bod\b = OD
\bbd\b = BD
\btds\b = TDS
\bqid\b = QID
\bsos\b = SOS
\bprn\b = PRN
\bhs\b = HS
\bac\b = AC
\bpc\b = PC
\bMetforrn\b = Metformin
\bMetfornin\b = Metformin
\bAmIodipine\b = Amlodipine
\bAtorvastatln\b = Atorvastatin
\bLevothyroxlne\b = Levothyroxine
(\d)\s+\.\s*(\d) = $1.$2
(\d),(\d{3}) = $1$2
"""

# Lab test = sex = low bound = high bound = borderline-high up to = high from
#               = deficient below = unit.
LAB_RANGES = """
blood_sugar_fasting = any = 70 = 99 = 125 = 126 = - = mg/dL
blood_sugar_pp = any = 70 = 139 = 199 = 200 = - = mg/dL
hba1c = any = 4.0 = 5.6 = 6.4 = 6.5 = - = %
tsh = any = 0.4 = 4.0 = - = 4.0 = - = mIU/L
t3 = any = 80 = 200 = - = - = - = ng/dL
t4 = any = 5.0 = 12.0 = - = - = - = µg/dL
total_cholesterol = any = 0 = 200 = 239 = 240 = - = mg/dL
ldl = any = 0 = 100 = 159 = 160 = - = mg/dL
hdl = male = 40 = 60 = - = - = - = mg/dL
hdl = female = 50 = 60 = - = - = - = mg/dL
triglycerides = any = 0 = 150 = 199 = 200 = - = mg/dL
systolic_bp = any = 90 = 120 = 139 = 140 = - = mmHg
diastolic_bp = any = 60 = 80 = 89 = 90 = - = mmHg
creatinine = male = 0.7 = 1.3 = - = - = - = mg/dL
creatinine = female = 0.5 = 1.1 = - = - = - = mg/dL
hemoglobin = male = 13.5 = 17.5 = - = - = - = g/dL
hemoglobin = female = 12.0 = 15.5 = - = - = - = g/dL
vitamin_d = any = 30 = 100 = - = - = 20 = ng/mL
vitamin_b12 = any = 200 = 900 = - = - = 200 = pg/mL
uric_acid = male = 3.4 = 7.0 = - = - = - = mg/dL
uric_acid = female = 2.4 = 6.0 = - = - = - = mg/dL
"""

# Words that mark a hospital name.
HOSPITAL_WORDS = """
hospital
clinic
centre
center
nursing home
medical college
health care
healthcare
polyclinic
dispensary
maternity home
super speciality
multispeciality
institute
infirmary
apollo
fortis
manipal
max healthcare
aiims
nimhans
medanta
aster
narayana
kokilaben
lilavati
hinduja
tata memorial
breach candy
bombay hospital
pgimer
"""

# The forms a doctor's name takes.
DOCTOR_FORMS = r"""
Dr\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*
Dr\s+[A-Z][A-Z]+\s+[A-Z][a-z]+
(?:Prof\.?|Professor)\s+Dr\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*
[A-Z][a-z]+\s+[A-Z][a-z]+\s*,\s*(?:MD|MBBS|MS|MCh|DM|DNB|FRCS|FACS|PhD)
"""

# Fragments that show a document speaks of a disease.
DISEASE_FRAGMENTS = """
diabetes, hypertension, thyroid, hypothyroid, hyperthyroid
cardiac, coronary, angina, infarct, stroke, arrhythmia
asthma, copd, pneumonia, tuberculosis
hepatitis, cirrhosis, fatty liver
epilepsy, migraine, parkinson, alzheimer, dementia
depression, anxiety, bipolar, schizophrenia
arthritis, osteoporosis, fibromyalgia
kidney, renal, nephritis, nephrotic
cancer, tumor, malignant, carcinoma
anemia, anaemia, thalassemia
gout, uric acid, hyperlipidemia, cholesterol
obesity, overweight
pcos, polycystic
cataract, glaucoma, retinopathy
eczema, psoriasis, dermatitis
dengue, malaria, typhoid
"""

# Extraction patterns (name = expression), matched ignoring case.
PATTERNS = r"""
dosage = \b(\d+\.?\d*)\s*(mg|mcg|ml|IU|units?|g|kg|mmol|µg|μg|ug|mEq|mg/ml)\b
frequency = \b(once\s+daily|twice\s+daily|thrice\s+daily|three\s+times\s+daily|four\s+times\s+daily|once\s+weekly|once\s+monthly|od|bd|tds|tid|qid|sos|prn|hs|ac|pc|stat|daily|weekly|monthly|at\s+bedtime|before\s+meals?|after\s+meals?|as\s+needed)\b
duration = (?:for|×|x|X)\s*(\d+)\s*(days?|weeks?|months?|years?)
lab_value = \b(HbA1c|Hb|TSH|T3|T4|FBS|PPBS|RBS|LDL|HDL|TG|TC|Hgb|Hematocrit|Platelets|WBC|RBC|Creatinine|eGFR|Uric\s+Acid|Vitamin\s+[DB]\d*|Ferritin|SGOT|SGPT|Bilirubin|Sodium|Potassium|Cholesterol|Triglycerides|INR|PT)\s*[:\-=]?\s*(\d+\.?\d*)\s*(mg/dL|mmol/L|mIU/L|µg/dL|ng/mL|g/dL|%|IU/L|pg/mL|mEq/L)?
blood_pressure = \b(?:BP|Blood\s+Pressure)\s*[:\-=]?\s*(\d{2,3})\s*/\s*(\d{2,3})\s*(?:mmHg)?
allergy = (?:allerg(?:ic|y)\s+to|contraindicated|NKDA|no\s+known\s+drug\s+allergy)\s*:?\s*([A-Za-z\s,]+)?
numeric_date = \b(\d{1,2})[/\-\.](\d{1,2})[/\-\.](\d{2,4})\b|\b(\d{4})[/\-\.](\d{1,2})[/\-\.](\d{1,2})\b
written_date = \b(\d{1,2})(?:st|nd|rd|th)?\s+(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+(\d{4})\b|\b(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b
relative_date = \b(?:after|in|within|next)\s+(\d+)\s+(days?|weeks?|months?|years?)\b
follow_up = \b(?:follow[\s\-]?up|F/?U|review|revisit|come\s+back|next\s+visit)\s*(?:after|on|in|@|:)?\s*(?:(\d+)\s*(days?|weeks?|months?)|(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}))
medicine_prefix = \b(Tab\.?|Tablet|Cap\.?|Capsule|Syrup|Inj\.?|Injection|Drops?|Cream|Gel|Oint(?:ment)?|Inhaler|Patch|Spray)\s+
diagnosis_header = ^(?:Diagnosis|Dx|Impression|Clinical\s+Diagnosis|Assessment)\s*:?\s*
rx_header = ^(?:Rx|R/|Treatment|Prescription|Medicines?)\s*:?\s*
"""

# External annotation label = entity type.
ANNOTATION_LABELS = """
B-DISEASE = DISEASE
I-DISEASE = DISEASE
B-CHEMICAL = MEDICINE
I-CHEMICAL = MEDICINE
B-DNA = TEST
B-PROTEIN = TEST_RESULT
B-CELL_TYPE = TEST
B-CELL_LINE = TEST
B-Drug = MEDICINE
I-Drug = MEDICINE
B-Disease_disorder = DISEASE
I-Disease_disorder = DISEASE
B-Diagnostic_procedure = TEST
I-Diagnostic_procedure = TEST
B-Lab_value = LAB_VALUE
I-Lab_value = LAB_VALUE
B-Dosage = DOSAGE
I-Dosage = DOSAGE
B-Frequency = FREQUENCY
I-Frequency = FREQUENCY
B-Duration = DURATION
I-Duration = DURATION
"""

# Entity types a stored entity may have; every other type is stored as "other".
STORED_ENTITY_TYPES = """
disease, medicine, dosage, doctor, hospital, date, test_result, test_name, symptom, allergy, other
"""

# Record types, extraction states, upload file types.
RECORD_TYPES = "prescription, lab_report, diagnosis, imaging, discharge_summary, vaccination, other"
EXTRACTION_STATES = "pending, processing, done, failed"
UPLOAD_FILE_TYPES = "jpg, jpeg, png, pdf, heic"

# relationship = generation above (+) or below (-) the user.
GENERATIONS = """
paternal_grandfather = 2
paternal_grandmother = 2
maternal_grandfather = 2
maternal_grandmother = 2
father = 1
mother = 1
uncle = 1
aunt = 1
brother = 0
sister = 0
husband = 0
wife = 0
partner = 0
cousin = 0
son = -1
daughter = -1
nephew = -1
niece = -1
other = 0
"""

# relationship = share of a relative's condition counted for the user (else 0.05).
SHARED_RISK_WEIGHTS = """
father = 0.35
mother = 0.35
paternal_grandfather = 0.20
paternal_grandmother = 0.20
maternal_grandfather = 0.20
maternal_grandmother = 0.20
brother = 0.15
sister = 0.15
uncle = 0.10
aunt = 0.10
cousin = 0.05
"""

# relationship = closeness weight of the hereditary pattern score (else 0.25).
CLOSENESS_WEIGHTS = """
parent = 2.0
father = 2.0
mother = 2.0
sibling = 1.8
brother = 1.8
sister = 1.8
child = 1.5
son = 1.5
daughter = 1.5
grandparent = 1.0
paternal_grandfather = 1.0
paternal_grandmother = 1.0
maternal_grandfather = 1.0
maternal_grandmother = 1.0
aunt_uncle = 0.5
uncle = 0.5
aunt = 0.5
cousin = 0.25
spouse = 0.1
"""

# Tracked disease = display name = ICD-10 prefix = heritability = model it feeds
#               = keywords (folded to lower case before matching).
HEREDITARY_DISEASES = """
type_2_diabetes = Type 2 Diabetes = E11 = 0.72 = diabetes = diabetes, E10, E11, diabetic, insulin
hypertension = Hypertension = I10 = 0.54 = hypertension = hypertension, I10, high blood pressure
hypothyroidism = Hypothyroidism = E03 = 0.67 = thyroid = hypothyroid, E03, hashimoto, underactive thyroid
hyperthyroidism = Hyperthyroidism = E05 = 0.79 = thyroid = hyperthyroid, E05, graves, overactive thyroid
coronary_artery_disease = Coronary Artery Disease = I25 = 0.56 = heart_disease = coronary, I25, cad, ischemic heart, angina, heart attack
depression = Depression = F32 = 0.40 = - = depression, F32, F33, major depressive
breast_cancer = Breast Cancer = C50 = 0.30 = - = breast cancer, C50, brca
colorectal_cancer = Colorectal Cancer = C18 = 0.35 = - = colorectal, colon cancer, C18, C19, C20
asthma = Asthma = J45 = 0.65 = - = asthma, J45, bronchial asthma
osteoporosis = Osteoporosis = M80 = 0.60 = - = osteoporosis, M80, M81, low bone density
"""

# Words in a member's conditions that colour the family-graph node.
NODE_HIGH_WORDS = "coronary, heart, stroke, cancer, diabetes, hypertension"
NODE_MODERATE_WORDS = "thyroid, asthma, depression, arthritis, kidney"

# Disease class = keywords, in the order in which the first matching class wins.
DISEASE_CLASSES = """
diabetes = diabet, E10, E11, insulin, glyco
hypertension = hypertens, I10, high blood pressure, bp
heart = cardiac, heart, coronary, angina, infarct, I20, I21, I25, I50
thyroid = thyroid, E03, E05, hypothyroid, hyperthyroid, tsh
cancer = cancer, tumor, carcinoma, malignant, neoplasm
"""

# Medication feature = drug names that count for it.
MEDICATION_SETS = """
diabetes_recurrence_count = metformin, glipizide, gliclazide, glimepiride, glibenclamide, sitagliptin, vildagliptin, dapagliflozin, empagliflozin, liraglutide, semaglutide, insulin, pioglitazone
hypertension_recurrence_count = amlodipine, enalapril, ramipril, lisinopril, losartan, telmisartan, metoprolol, atenolol, bisoprolol, furosemide, hydrochlorothiazide, spironolactone
thyroid_med_count = levothyroxine, thyroxine, liothyronine, carbimazole, propylthiouracil
heart_med_count = atorvastatin, rosuvastatin, aspirin, clopidogrel, warfarin, rivaroxaban, apixaban, nitrate, isosorbide
"""

# Lab label fragment = feature it sets.
LAB_FEATURES = """
fbs = latest_blood_sugar_fasting
blood_sugar_fasting = latest_blood_sugar_fasting
hba1c = latest_hba1c
tsh = latest_tsh
systolic = latest_systolic_bp
bp_systolic = latest_systolic_bp
diastolic = latest_diastolic_bp
bp_diastolic = latest_diastolic_bp
cholesterol = latest_cholesterol
total_cholesterol = latest_cholesterol
ldl = latest_ldl
hdl = latest_hdl
triglycerides = latest_triglycerides
creatinine = latest_creatinine
vitamin_d = latest_vitamin_d
vit_d = latest_vitamin_d
bmi = latest_bmi
"""

# feature = type = population median used when the value is missing.
FEATURES = """
age = double = 40.0
gender_male = int = 0
bmi = double = 23.5
has_diabetes_history = int = 0
has_hypertension_history = int = 0
has_thyroid_history = int = 0
has_heart_history = int = 0
disease_count = int = 0
unique_medicines_count = int = 0
record_count = int = 0
years_of_history = double = 0
latest_blood_sugar_fasting = double = 90.0
latest_hba1c = double = 5.4
latest_tsh = double = 2.2
latest_systolic_bp = double = 118.0
latest_diastolic_bp = double = 76.0
latest_cholesterol = double = 185.0
latest_ldl = double = 110.0
latest_hdl = double = 48.0
latest_triglycerides = double = 130.0
latest_creatinine = double = 0.9
latest_vitamin_d = double = 25.0
latest_bmi = double = 0
diabetes_recurrence_count = int = 0
hypertension_recurrence_count = int = 0
thyroid_med_count = int = 0
heart_med_count = int = 0
parent_diabetes = int = 0
grandparent_diabetes = int = 0
sibling_diabetes = int = 0
family_diabetes_count = int = 0
parent_hypertension = int = 0
grandparent_hypertension = int = 0
family_hypertension_count = int = 0
grandparent_heart_disease = int = 0
parent_heart_disease = int = 0
family_heart_count = int = 0
parent_thyroid = int = 0
family_thyroid_count = int = 0
family_cancer_count = int = 0
exercise_regularity = double = 0.3
diet_quality_score = double = 0.5
"""

# model = disease name = ICD-10 code = health-score weight = input features in order.
RISK_MODELS = """
diabetes = Type 2 Diabetes = E11 = 25 = age, gender_male, bmi, latest_bmi, latest_blood_sugar_fasting, latest_hba1c, has_diabetes_history, diabetes_recurrence_count, disease_count, parent_diabetes, grandparent_diabetes, sibling_diabetes, family_diabetes_count, thyroid_med_count, exercise_regularity, diet_quality_score
hypertension = Hypertension = I10 = 25 = age, gender_male, bmi, latest_bmi, latest_systolic_bp, latest_diastolic_bp, has_hypertension_history, hypertension_recurrence_count, has_diabetes_history, latest_blood_sugar_fasting, latest_cholesterol, latest_creatinine, parent_hypertension, grandparent_hypertension, family_hypertension_count, exercise_regularity, diet_quality_score, disease_count
thyroid = Thyroid Disorder = E03.9 = 20 = age, gender_male, latest_tsh, has_thyroid_history, thyroid_med_count, parent_thyroid, family_thyroid_count, has_diabetes_history, disease_count, exercise_regularity
heart_disease = Cardiovascular Disease = I25.1 = 30 = age, gender_male, bmi, latest_bmi, latest_systolic_bp, latest_diastolic_bp, latest_cholesterol, latest_ldl, latest_hdl, latest_triglycerides, has_heart_history, heart_med_count, has_diabetes_history, has_hypertension_history, hypertension_recurrence_count, latest_blood_sugar_fasting, grandparent_heart_disease, parent_heart_disease, family_heart_count, exercise_regularity, diet_quality_score
"""

# model = feature = weight = source = label (a printf format when it shows the value).
FACTORS = """
diabetes = has_diabetes_history = 0.30 = medical_history = Personal history of diabetes
diabetes = latest_hba1c = 0.25 = lab = HbA1c: %.1f%%
diabetes = latest_blood_sugar_fasting = 0.22 = lab = Fasting blood sugar: %.0f mg/dL
diabetes = parent_diabetes = 0.18 = family = Parent has diabetes
diabetes = grandparent_diabetes = 0.10 = family = Grandparent had diabetes
diabetes = bmi = 0.08 = clinical = BMI: %.1f kg/m²
diabetes = exercise_regularity = 0.06 = lifestyle = Exercise regularity
diabetes = family_diabetes_count = 0.05 = family = Total family members with diabetes
hypertension = has_hypertension_history = 0.28 = medical_history = Personal history of hypertension
hypertension = latest_systolic_bp = 0.24 = lab = Systolic BP: %.0f mmHg
hypertension = parent_hypertension = 0.16 = family = Parent has hypertension
hypertension = bmi = 0.10 = clinical = Body mass index
hypertension = age = 0.08 = demographic = Age factor
hypertension = diet_quality_score = 0.06 = lifestyle = Diet quality (low salt intake)
thyroid = has_thyroid_history = 0.30 = medical_history = Personal history of thyroid disorder
thyroid = latest_tsh = 0.25 = lab = TSH: %.2f mIU/L
thyroid = gender_male = 0.20 = demographic = Female gender (3× higher thyroid risk)
thyroid = parent_thyroid = 0.15 = family = Parent has thyroid disorder
thyroid = family_thyroid_count = 0.08 = family = Family members with thyroid disorder
heart_disease = has_heart_history = 0.30 = medical_history = Personal history of heart disease
heart_disease = age = 0.22 = demographic = Age: %d years
heart_disease = latest_cholesterol = 0.18 = lab = Cholesterol: %.0f mg/dL
heart_disease = has_diabetes_history = 0.15 = clinical = Diabetes (major cardiac risk factor)
heart_disease = parent_heart_disease = 0.12 = family = Parent had heart disease
heart_disease = has_hypertension_history = 0.10 = clinical = Hypertension (major cardiac risk factor)
"""

# Recommendation category = priority = levels = disease words (- for everyone)
#               = title = description = action.
RECOMMENDATIONS = """
diet = urgent = high, moderate = diabetes, type 2 diabetes = Reduce refined sugar intake = Cut refined carbohydrates by 30%. Replace with complex carbs: whole grains, lentils, and leafy vegetables. = Set a daily dietary reminder.
exercise = recommended = high, moderate, low = diabetes, hypertension, hypothyroidism = 30 min brisk walk daily = Morning walks before breakfast improve insulin sensitivity, regulate blood pressure, and support thyroid metabolism. = Set a morning walk reminder.
checkup = urgent = high = diabetes, type 2 diabetes = Annual HbA1c blood test = HbA1c measures average blood sugar over 3 months. Essential given high diabetes risk. = Schedule a lab appointment.
diet = recommended = high, moderate = hypothyroidism, thyroid = Increase iodine-rich foods = Include seafood, iodized salt, dairy, and eggs in your diet. Iodine supports thyroid hormone production. = Update your meal plan.
checkup = recommended = high, moderate = heart disease, hypertension, coronary = Annual cardiac screening = ECG + lipid profile test annually. Recommended given cardiovascular family history. = Book with a cardiologist.
sleep = optional = high, moderate, low = - = 8 hours consistent sleep = Consistent sleep schedules regulate cortisol and insulin. Especially important for thyroid and metabolic health. = Set a bedtime reminder.
"""

# Recommendation category = display label.
CATEGORY_LABELS = """
diet = 🍽️ Diet
exercise = 🏃 Exercise
sleep = 😴 Sleep
checkup = 🩺 Checkup
mental = 🧠 Mental Health
"""

# Risk level = watchlist advice.
WATCHLIST_ACTIONS = """
high = Schedule an immediate consultation with a specialist.
moderate = Request an annual screening test and monitor regularly.
low = Maintain healthy lifestyle habits and monitor annually.
"""

# Sentences shown to users, with places for the values.
HEALTH_SENTENCE = (
    "Hello {name}! Your current health score is {score}/100. Your primary areas to monitor are {risks}. "
    "Stay on top of your annual checkups and follow your personalised plan."
)
NO_RISKS = "no significant conditions"
# Least weighted score and sentence, strongest first.
HERITABILITY_SENTENCES = (
    (2.25, "Strong family history across multiple generations. This condition has {percent} heritability. Regular screening is strongly recommended."),
    (1.5, "Significant family history detected. With {percent} heritability, early detection and prevention are important."),
    (0.0, "Moderate family history detected. This condition has {percent} heritability. Maintain awareness and schedule routine checkups."),
)

"""The small labelled table from which the tagger of personal details is trained.

All of it is written from general knowledge of how clinical text names people and how numbers,
addresses and e-mails are formatted; no row is taken from any table of notes (a test compares them).
A row joins a frame, whose ``{slot}`` is filled with an invented detail, to an opening and an ending
drawn at random, so that the field learns cues and formats instead of sentences. The draw is seeded,
so the table is the same everywhere.
"""

from __future__ import annotations

import random

KINDS = ("email", "phone", "id_number", "address", "name")

# Common given names.
GIVEN = (
    "Aaron Abigail Adam Ahmed Aiko Alan Alice Amir Amelia Ana Andrea Angela Anton Arthur Astrid Barbara Beatrice Bernard Bianca Boris Brian Camille Carla Cecilia Chen Claire "
    "Claudia Colin Cynthia Dagmar Daniel Deepa Denise Diego Dorothy Edith Elena Emil Erika Esther Eva Fatima Felix Fiona Frank Gail George Gloria Grace Graham Hana Hannah Harold "
    "Hassan Heidi Helen Hugo Igor Irene Isabel Ivan Jack Jane Janet Jean Jorge Joyce Juan Julia Karen Karl Kenji Kevin Klaus Laura Leila Leon Linda Louis Lucas Luis Magda Marco "
    "Margaret Maria Mark Marta Martin Mary Maya Mei Michael Miguel Mohammed Monica Naomi Natalia Neil Nicole Nina Nora Olga Oliver Oscar Pablo Paul Pauline Petra Philip Priya Rachel "
    "Rafael Raj Ralph Ravi Rita Roger Rosa Ruth Samir Sandra Sara Simon Sofia Stefan Stella Sven Theo Thomas Tina Ursula Vera Victor Walter Wei Wendy William Yusuf Yvonne Zoe"
).split()
# Common surnames; others are made up by rule.
SURNAME = (
    "Adams Ali Allen Andersson Bauer Becker Bell Bennett Bernard Brown Campbell Carter Chen Clark Cohen Collins Cooper Cruz Davies Diaz Dubois Edwards Evans Fischer Foster Garcia Gonzalez "
    "Green Hall Hansen Harris Hill Hoffmann Ito Jackson Jansen Johnson Jones Khan Kim King Kowalski Kumar Lambert Lee Lewis Lopez Martin Meyer Miller Mitchell Moore Moreau Morgan Murphy "
    "Nakamura Nelson Nguyen Novak O'Brien Olsen Parker Patel Perez Petrov Phillips Price Reed Reyes Richter Rivera Roberts Robinson Rossi Ryan Sanchez Santos Schmidt Scott Shah Silva "
    "Smith Sokolov Stewart Suzuki Taylor Thompson Torres Turner Walker Ward Watson Weber White Williams Wilson Wong Wright Yamamoto Young Zhang"
).split()

HEADS = "Al Bar Bel Ber Bran Cal Cor Dal Del Dor El Fal Fen Gar Gol Hal Har Hol Jan Kar Kel Kor Lam Lin Lor Mal Mar Mel Mon Nor Ol Or Pel Per Pol Ral Ren Ros Sal Sel Sor Stan Tal Tor Ul Val Van Var Vel Wal Wes Wil Yar Zel Zor".split()
MIDS = ["", "", "a", "e", "i", "o", "an", "ar", "en", "er", "in", "ol", "or", "u"]
TAILS = "berg by dale dini dottir esku feld ford gaard ham hart holm ič insky ius ková land ley man mann mark mead more nen nik nova off osz ova quist rath rell ritz sen ski son stad stein sund ter thorpe ton vic vik ville wald well wick wood worth yan zadeh".split()
DRUG_ENDS = "alol azole caine cillin cycline done dipine floxacin gliptin idine mab mycin nib olol oxetine pam parin pine pril profen sartan statin thiazide tidine triptan vir zepam".split()
WORD_ENDS = "ation ement ent ing ive ous al ed ic ly s ure".split()


class Draw:
    """Invented details, from one seeded source."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def one(self, xs):
        return self.r.choice(xs)

    def digits(self, n: int) -> str:
        return "".join(str(self.r.randrange(10)) for _ in range(n))

    def made_up(self) -> str:
        return self.one(HEADS) + self.one(MIDS) + self.one(TAILS)

    def given(self) -> str:
        return self.one(GIVEN) if self.r.random() < 0.7 else self.one(HEADS) + self.one(["a", "an", "el", "ia", "ik", "in", "o", "us", "ya", "ine"])

    def surname(self) -> str:
        s = self.one(SURNAME) if self.r.random() < 0.3 else self.made_up()
        if self.r.random() < 0.06:
            s += "-" + self.made_up()
        return self.one(["van ", "de ", "Mc", "O'"]) + s if self.r.random() < 0.04 else s

    def full(self) -> str:
        middle = f" {self.one('ABCDEFGHJKLMNPRSTW')}." if self.r.random() < 0.2 else ""
        return f"{self.given()}{middle} {self.surname()}"

    def turned(self) -> str:
        return f"{self.surname()}, {self.given()}" + (f" {self.one('ABCDEFGHJKLMNPRSTW')}" if self.r.random() < 0.3 else "")

    def initial(self) -> str:
        return f"{self.given()[0]}. {self.surname()}"

    def person(self) -> str:
        return self.one([self.full, self.full, self.initial])()

    def phone(self) -> str:
        a, b, c = self.one("23456789") + self.digits(2), self.digits(3), self.digits(4)
        forms = [
            f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}{b}{c}", f"{b}-{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}",
            f"1-8{self.one('0678') * 2}-{b}-{c}", f"+{self.one(['44', '49', '33', '34', '39', '61'])} {self.digits(2)} {self.digits(4)} {c}", f"0{self.digits(2)} {self.digits(4)} {c}", f"0{self.digits(4)} {self.digits(6)}",
            f"+{self.one(['44', '49', '33'])} {self.digits(4)} {self.digits(6)}", f"+{self.one(['44', '49', '33'])}{self.digits(9)}",
        ]
        return self.one(forms)

    def ssn(self) -> str:
        a, b, c = self.digits(3), self.digits(2), self.digits(4)
        return self.one([f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}{b}{c}"])

    def record(self) -> str:
        return self.one([self.digits(6), self.digits(7), self.digits(8), self.digits(8), f"{self.digits(2)}-{self.digits(2)}-{self.digits(2)}", f"{self.digits(3)}-{self.digits(3)}", self.one("ABM") + self.digits(7)])

    def coded(self) -> str:
        x, y = self.one("ABCDEFGHJKLMNPRSTUVWXYZ"), self.one("ABCDEFGHJKLMNPRSTUVWXYZ")
        return self.one([f"{x}{y}{self.digits(7)}", f"{x}{self.digits(8)}", f"{x}{y}{self.digits(7)}{x}", f"{x}{y}{self.one('CKM')}{self.digits(9)}", self.digits(9), f"{x}{y}{self.digits(6)}"])

    def place(self) -> str:
        return self.one(["Port ", "New ", "East ", "", "", "", ""]) + self.made_up() + self.one(["", "", "", " Falls", " Heights", " Bay"])

    def address(self) -> str:
        n = self.one([self.digits(1), self.digits(2), self.digits(3), self.digits(4)]).lstrip("0") or "7"
        n += self.one(["", "", "", "", "", self.one("ABC")])
        kind = self.one("Street Street St. Street St Road Road Rd Rd. Avenue Ave Ave. Lane Lane Ln Drive Dr. Court Ct Boulevard Blvd Place Terrace Way Crescent Close Square Parkway Hill Row Circle".split())
        name = self.one([self.made_up(), self.made_up(), self.one(["Oak", "Maple", "Church", "Mill", "Park", "High", "King", "Station", "Lake", "Washington"]), f"{self.one(['North', 'W', 'Old', 'Saint'])} {self.made_up()}", f"{self.digits(1) or 4}th"])
        flat = self.one(["", "", "", "", f", Apt {self.digits(2)}", f", Apt. {self.digits(1)}{self.one('ABC')}", f" Unit {self.digits(2)}", f", Suite {self.digits(3)}", f" #{self.digits(2)}"])
        town = self.one(["", "", f", {self.place()}", f", {self.place()}", f", {self.place()}, {self.one(['MA', 'NY', 'OH', 'TX'])} {self.digits(5)}"])
        forms = [f"{n} {name} {kind}{flat}{town}"] * 8 + [
            f"{self.one(['P.O. Box', 'PO Box', 'P. O. Box', 'Post Office Box'])} {self.digits(self.one([2, 3, 4]))}{town}",
            f"{self.one(['P.O. Box', 'PO Box'])} {self.digits(self.one([3, 4, 5]))}{town}",
            f"{n} rue {self.one(['de ', 'du ', '', ''])}{self.made_up()}{town}",
            f"{self.one(['rue', 'Rue', 'via', 'Calle', 'avenue'])} {self.made_up()} {n}{town}",
            f"{self.made_up()}{self.one(['straße', 'strasse', 'weg', 'gasse', 'allee', 'platz'])} {n}{town}",
            f"{n} {self.made_up()}{self.one(['straat', 'gatan', 'vej'])}{town}",
        ]
        return self.one(forms)

    def email(self) -> str:
        g, s = self.given().lower(), self.one([self.made_up().lower(), self.one(SURNAME).lower()]).replace("'", "")
        local = self.one([f"{g}.{s}", f"{g[0]}{s}", f"{g}_{s}", f"{s}{self.digits(2)}", g, f"{g[0]}.{s}", f"{s}.{g}", f"{g}+{self.word()}", f"{g}-{s}", f"{s}_{self.digits(4)}"])
        host = self.one([self.word(), f"{self.word()}{self.word()}", f"{self.word()}-{self.word()}", f"mail.{self.word()}", f"{self.word()}.{self.one(['co', 'ac', 'med'])}"])
        top = self.one("com org net edu gov info io uk de fr es ca eu example test invalid".split())
        joins = [("@", "."), ("@", "."), ("@", "."), (" (at) ", "."), (" [at] ", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), (" at ", "."), ("(at)", "."), (" @ ", ".")]
        at, dot = self.one(joins)
        out = f"{local}{at}{host.replace('.', dot)}{dot}{top}"
        return out.upper() if self.r.random() < 0.1 else out

    def word(self) -> str:
        """A lower-case word, known or made up."""
        return self.one(WORDS) if self.r.random() < 0.8 else (self.one(HEADS) + self.one(MIDS) + self.one(WORD_ENDS)).lower()

    def drug(self) -> str:
        return (self.one(HEADS) + self.one(MIDS) + self.one(DRUG_ENDS)).lower()

    def unit(self) -> str:
        return self.one(UNITS)

    def finding(self) -> str:
        return self.one(STEMS) + self.one(ENDINGS_OF_FINDINGS)

    def number(self) -> str:
        return self.one([self.digits(1), self.digits(2), self.digits(3), f"{self.digits(1)}.{self.digits(1)}", f"{self.digits(2)}.{self.digits(2)}", f"{self.digits(3)}/{self.digits(2)}", f"{self.digits(2)}%"])

    def date(self) -> str:
        return self.one([f"{self.digits(2)}/{self.digits(2)}/{self.digits(4)}", f"20{self.digits(2)}-0{self.digits(1)}-1{self.digits(1)}", f"{self.one(MONTHS)} {self.digits(1)}", f"{self.digits(2)}:{self.digits(2)}", f"{self.one(MONTHS)} 20{self.digits(2)}", str(self.r.randrange(1950, 2030)), str(self.r.randrange(1950, 2030))])

    def code(self) -> str:
        """A number that is nobody's: of an order, a lot, a specimen and the like, in any format."""
        return self.one([self.phone, self.ssn, self.record, self.record, self.coded])().lstrip("+(").replace(")", "")


MONTHS = "January February March April May June July August September October November December".split()
WORDS = (
    "abdominal acute admission afternoon airway alert anxious appetite arm arrival aspirin back balance bed bilateral biopsy bleeding blood bowel breath calm cardiac care cell chair chest chronic clear clinic cold colour "
    "comfortable consent constipation culture daily diet discharge distress dizzy drain dressing drip evening exercise family fasting fatigue fever film fluid follow foot fracture gait glucose goals hand headache healing heart "
    "heparin hip hourly hypertension improved infection infusion insulin intact intake kidney knee lab left leg level limited liver lung mask meal medication mild mobility moderate monitoring morning mother mouth muscle nausea "
    "neck negative nerve night normal nursing oral overnight oxygen pain patient plan pleasant pneumonia positive pressure procedure progress pulse pupils rash rate recovery renal repeat respiratory rest result right room "
    "safety saline scan sepsis severe shift shoulder skin sleep stable stairs stomach stroke surgery swelling symptoms team temperature therapy tolerated tube ulcer unit unsteady urine vein vital vomiting walker ward weak weight wound"
).split()

VERBS = (
    "started stopped given held continued increased decreased changed removed placed inserted tolerated completed refused requested ordered sent drawn repeated checked cleaned dressed drained advised offered encouraged educated explained "
    "monitored observed noted found reported denied improved worsened resolved persisted returned required received administered applied assessed reassessed turned repositioned ambulated walked fed bathed suctioned extubated intubated "
    "weaned titrated transfused cultured scanned imaged admitted discharged cleared planned scheduled cancelled postponed awaited counselled recommended considered suspected excluded confirmed compared measured recorded charted understands wants needs sleeps eats drinks rests"
).split()
NOUNS = (
    "allergy activity ambulation analgesia antibiotics anxiety assistance bath bedside bladder bowels breakfast catheter colonoscopy commode confusion cough crackles creatinine delirium dialysis dinner dysuria echocardiogram edema education electrolytes endoscopy "
    "events exam fall fluids gauze grip haemoglobin heels hygiene incision infiltrate iron lactate lens lesion linen lipids lunch lymphocytes margin microbiology mood motion murmur neutrophils nodule orientation pacemaker pathology perfusion phlegm physio platelets "
    "position potassium protein readiness reflexes rhythm secretions sensation site sodium speech spirits sputum strength suture swallow teaching telemetry tenderness thirst throat tone tongue traction transfer tremor troponin ultrasound understanding vision voice waist wheeze"
).split()

UNITS = "mg mg mL ml mcg g kg L IU units mmol/L mEq/L mg/dL g/dL g/L U/L IU/L ng/mL mmHg bpm cm mm % L/min mL/h mg/kg µg/kg mcg/kg tabs puffs drops".split()
GRADES = "mild moderate severe marked slight minimal diffuse focal early late partial complete subtle extensive acute chronic new old small large recent likely possible probable unlikely no resolving worsening unchanged".split()
STEMS = "arthr aden angi bronch card cerebr cholecyst chondr col cyst derm encephal enter fibr gastr gli gloss haem hepat hist kerat laryng leuk lip lymph men mening my myel necr nephr neur oste ot pancreat pharyng phleb pleur pneum prostat py rhin sarc scler sin spondyl splen stomat tendin thromb thyroid trache ur vascul ven".split()
ENDINGS_OF_FINDINGS = "itis osis oma opathy aemia algia ectasia uria omegaly oplasia otrophy orrhage ectomy ostomy oscopy ography otomy".split()
REGIONS = "abdominal biliary bronchial cardiac carotid cerebral cervical colonic cutaneous dental femoral gastric hepatic iliac lumbar mammary nasal neural ocular oral ovarian pelvic pulmonary rectal renal sacral spinal splenic thoracic thyroid tibial urinary uterine vascular venous".split()

#: Frames by the slot that they hold. {word}, {drug}, {number}, {date} and {code} are no details.
FRAMES: dict[str, list[str]] = {
    "surname": """
        Dr. {x}|Dr {x}|Doctor {x}|Prof. {x}|Professor {x}|Mr. {x}|Mrs. {x}|Ms. {x}|Miss {x}|Mr {x}|Mrs {x}|Ms {x}|Nurse {x}|Dear Dr. {x},|Dear Mrs. {x}:|evaluated by Dr. {x}|examined with Dr {x}
        paged Dr. {x} for {word}|d/w Dr. {x}|will follow up with Dr. {x} in {number} weeks|under the care of Dr. {x}|Thank you, Dr. {x}, for sending this {word} patient|PCP Dr. {x} notified|PCP is Dr. {x}
        Mr. {x} is a {number} year old man with {word} {word}|Mrs. {x} is a {number} year old woman|Ms. {x} tolerated the {word}|Ms {x} was admitted on {date}|Dr. {x} aware|Mr. {x} denies {word}|told Mr {x} to stop {drug}
        Mrs. {x} remains {word}|Miss {x} reports {word}|baby boy {x} born on {date}|Dr. {x}'s office|surgeon Dr. {x}|Dr. {x} placed the {word}|Drs. {x} present|Nurse {x} took over at {date}|RN {x} notified|Sgt. {x} brought the patient
        per Dr. {x}|per Dr. {x}, hold {drug}|appreciate recs from Dr. {x}|on-call physician Dr. {x}|Mr. {x} requests {word}|therapist Ms. {x} will visit|chaplain Mr. {x} came|Dr. {x} to see in the {word}""",
    "given": """
        husband {x}|wife {x}|son {x}|daughter {x}|partner {x}|his brother {x}|her sister {x}|aunt {x}|nephew {x}|father {x}|mother {x}|lives with her husband {x}|his wife {x} is present|daughter {x} phoned for news
        son {x} at the bed|called daughter {x} with the {word} result|sister {x} would like to be told|grandson {x} helps with the {word}|niece {x} brought clothes|friend {x} drove the patient|neighbour {x} found the patient on the floor
        Patient's wife, {x}, was present|her son, {x}, agrees|his daughter {x} will stay overnight|fiance {x}|grandmother {x}|caregiver {x}|roommate {x} says|my colleague {x}|uncle {x} is the proxy|spouse {x} updated
        sitter {x} present|pt goes by {x}|prefers to be called {x}|twin {x} is well""",
    "person": """
        seen by {x}|signed by {x}|Electronically authenticated by {x}|dictated by: {x}|Transcribed by {x}|reviewed by {x}|Reviewed with {x}|cosigned by {x}|discussed with {x}|spoke with {x}|spoke to {x}|spoke w/ {x} re {word}|talked with {x}
        talked to {x} about {word}|per {x}|called {x}|updated {x} by phone|informed {x}|Attending: {x}|Attending physician: {x}|Surgeon: {x}|Assistant: {x}|Anesthesiologist: {x}|Provider: {x}|Author: {x}|Referring physician: {x}|PCP: {x}
        Consultant: {x}|cc: {x}|CC {x}|Resident: {x}|Witness: {x}|Interpreter: {x}|Emergency contact: {x}|emergency contact is {x}|Next of kin: {x}|next of kin {x} told|health care proxy is {x}|HCP: {x}|Guarantor: {x}|Guardian: {x}
        {x}, MD|{x}, M.D.|{x} MD|{x}, RN|{x} RN|{x}, NP|{x}, PhD|{x}, DO|{x} PT|{x}, PA-C|handover from {x} RN|report given to {x}, RN|{x} NP to follow|{x}, LICSW, met with the family|case manager {x}|social worker {x}|dietitian {x}|pharmacist {x} checked {drug}
        physical therapist {x}|referred by {x}|referred to {x} for {word}|{x} (wife)|{x} (husband)|{x} (son)|{x} (daughter)|{x} (mother) will visit|{x} (partner) brings {word}|{x} (guardian)|{x} (PCP)|{x}, his wife, called|{x}, her daughter, agrees
        Patient: {x}|Pt: {x}|patient named {x}|the patient, {x}, was found|RE: {x}|Re {x}|Name {x}|Name: {x}|Full name: {x}|{x} is a {number} year old with {word}|{x} was admitted with {word}|{x} was seen in clinic|{x} came to the {word}
        pt {x} refused {drug}|accompanied by {x}|care handed to {x}|assisted by {x}|verified by {x}|read back by {x}|Sincerely, {x}|Regards, {x}|/s/ {x}|entered by {x} on {date}|witnessed by {x}|lab called, {x} took the value
        page {x} with changes|message left for {x}|consent obtained by {x}|procedure done by {x}|prepared by {x}|approved: {x}|contact person {x}|visited by {x}|letter from {x}|seen with {x}|d/w {x}|w/ {x}|authorised by {x}|by {x}""",
    "turned": """
        Patient: {x}|Patient name: {x}|Name: {x}|NAME: {x}|Pt name {x}|Last, first: {x}|Attending: {x}|Provider: {x}|{x} was discharged|Re: {x}|Subject: {x}|Chart of {x}|label reads {x}|wristband reads {x}|bracelet: {x}|Resident: {x}
        Account holder: {x}|Signed: {x}|Admitted: {x}|Bed {number}: {x}|identity confirmed as {x}|name and birth date ({x}) checked""",
    "phone": """
        tel {x}|Tel. {x}|Tel: {x}|telephone {x}|Telephone: {x}|phone {x}|Phone: {x}|phone number {x}|phone number is {x}|ph {x}|Ph. {x}|ph: {x}|cell {x}|Cell: {x}|cell phone {x}|mobile {x}|mobile no. {x}|home {x}|work number: {x}
        fax {x}|Fax: {x}|fax to {x}|pager {x}|Pager: {x}|beeper {x}|contact number {x}|contact no {x}|call back at {x}|callback {x}|reach him at {x}|reached at {x}|can be reached at {x}|reachable under {x}|call {x}|please call {x}
        call the office at {x}|dial {x}|ring {x}|text {x}|left a message at {x}|left voicemail on {x}|number on file {x}|clinic line {x}|office {x}|hotline {x}|daughter's number is {x}|his number is {x}|wife ({x})|son ({x}) to be told
        mother at {x}|Emergency contact {x}|questions: {x}|for refills {x}|pharmacy {x}|pharmacy at {x}|{x} (cell)|{x} (home)|{x} (work)|{x} is the best number|appointments {x}|nurse line {x}|try {x} after {date}|ward extension {x}
        no answer at {x}|Call {x} if {word}|Contact {x}|contact: {x}|or {x}|transfer centre {x}|whatsapp {x}|landline {x}|switchboard {x}|phoned {x} twice""",
    "ssn": """
        SSN {x}|SSN: {x}|SSN# {x}|ss# {x}|SS number {x}|social security number {x}|Social Security No. {x}|social security: {x}|soc. sec. {x}|Social Security # {x}|soc sec number {x}|social {x}|his social security number is {x}
        SSN {x} given by wife|SSN of patient is {x}|verified with SSN {x}|ssn ending in full {x}|tax form shows SSN {x}|identity: SSN {x}""",
    "record": """
        MRN {x}|MRN: {x}|MRN# {x}|MRN#{x}|mrn {x}|MR# {x}|MR #{x}|MR number {x}|medical record number {x}|Medical Record No. {x}|Medical record #: {x}|medical record: {x}|med rec no {x}|Med. Rec. # {x}|Unit no: {x}|hospital number {x}|Hospital no. {x}
        patient number {x}|patient ID {x}|Patient ID: {x}|Pt ID {x}|chart number {x}|chart no. {x}|chart # {x}|record number {x}|record no {x} found|old MRN {x}|duplicate MRN {x}|filed under MRN {x}|MRN is {x}|with medical record number {x}""",
    "coded": """
        passport {x}|Passport: {x}|passport no. {x}|passport number {x}|Passport # {x}|passport {x} shown|copy of passport {x}|travel document, passport {x}|insurance member {x}|insurance ID {x}|Insurance ID: {x}|member ID {x}|Member ID: {x}|member no. {x}
        member number {x}|Member # {x}|insurance number {x}|insurance no. {x}|policy number {x}|Policy no. {x}|policy # {x}|subscriber ID {x}|subscriber {x}|health plan ID {x}|health insurance member number {x}|Medicare number {x}|Medicaid ID {x}|plan member {x}
        insurer lists member {x}|insured under ID {x}|coverage under member number {x}""",
    "address": """
        lives at {x}|Lives at {x}|lives alone at {x}|resides at {x}|residing at {x}|living at {x} with {word}|address {x}|Address: {x}|address: {x}|address is {x}|home address {x}|mailing address: {x}|new address {x}|Home: {x}
        discharged to {x}|discharged home to {x}|transferred to {x}|moved to {x}|moved from {x}|now staying at {x}|stays with his {word} at {x}|send mail to {x}|please send the letter to {x}|send results to {x}|mail to {x}|letter to {x}
        picked up at {x}|found down at {x}|found outside {x}|brought in from {x}|ambulance called to {x}|fell at {x}|house at {x}|apartment at {x}|home visit at {x}|visiting nurse to {x}|deliver oxygen to {x}|deliver to {x}|equipment goes to {x}
        returns to {x}|office: {x}|clinic at {x}|pharmacy at {x}|located at {x}|next of kin at {x}|shelter at {x}|nursing home at {x}|bills to {x}|billing address {x}|home is {x}, {number} steps""",
    "email": """
        email {x}|Email: {x}|e-mail {x}|E-mail: {x}|e-mail address {x}|email address is {x}|email: {x}|mail {x}|mailto:{x}|write to {x}|writes from {x}|contact {x}|Contact: {x}|contact by email at {x}|reach her at {x}|reached at {x}|send results to {x}
        send records to {x}|please send a copy to {x}|portal account {x}|portal login {x}|daughter ({x})|son ({x}) asks|wife {x}|cc {x}|copy to {x}|reply to {x}|his address is {x}|questions to {x}|{x} preferred|{x} for updates|forwarded to {x}
        message from {x}|sent by {x}|emailed {x}|emailed to {x}|invoice to {x}|or {x}|family: {x}|caregiver <{x}>|enrolled with {x}""",
}
_KIND = {"surname": "name", "given": "name", "person": "name", "turned": "name", "phone": "phone", "ssn": "id_number", "record": "id_number", "coded": "id_number", "address": "address", "email": "email"}

#: Look-alikes and plain text, without details.
NOTHING = """
    Order {code}|order # {code}|Order no. {code} for {word}|order number {code} placed|lot {code}|Lot # {code}|lot number {code}|lot no. {code}, vial {number}|specimen {code}|Specimen # {code}|specimen number {code} sent|sample {code}|accession {code}|Accession # {code}
    accession number {code}|batch {code}|batch no. {code}|serial number {code}|serial no. {code} of the pump|device {code}|model {code}|ticket {code}|invoice {code}|requisition {code}|request {code} closed|protocol {code}|trial {code}|tube {code}|barcode {code}|tracking number {code}|kit {code}|slide {code}
    case {code}|reference {code}|confirmation {code}|job {code}|prescription {code}|Rx {code}|order #{code} filled|specimen {code} clotted|blood unit {code}|cassette {code}|catalogue no {code}
    {eponym} disease|{eponym}'s disease|{eponym} syndrome|{eponym} sign|{eponym}'s sign|{eponym} score {number}|{eponym} scale {number}|{eponym} test|{eponym} phenomenon|{eponym} lymphoma|{eponym} palsy|{eponym} catheter|{eponym} tube|{eponym} drain|{eponym} monitor|{eponym} fracture
    {eponym} maneuver|{eponym} procedure|{eponym} position|{eponym} virus|{eponym} reflex|{eponym} contracture|{eponym} dementia|{eponym} coma scale|{eponym} criteria|{eponym} classification|{eponym} thyroiditis|{eponym} needle|{eponym} line|{eponym} bodies|{eponym} cells|{eponym} stain|{eponym} mask|{eponym} ulcer
    {eponym} disease excluded, {eponym} sign untested|known {eponym} disease on {drug}|{eponym} syndrome, {eponym} test {word}|history of {eponym} palsy|{eponym} catheter in place, draining|{eponym} score of {number} at {date}|no {eponym} sign|positive {eponym} test|removed {eponym} drain
    [**First Name**] called|[**Last Name (STitle)**] to see|Dr. [**Name**] aware|[**Hospital1 18**] records|seen by <NAME>|call [PHONE]|[REDACTED] signed|[NAME], MD|lives at [ADDRESS]|MRN [ID]|email [EMAIL]|Dr. [REDACTED] will follow|Dr. covering aware of {word}|Dr. on duty paged
    {W} {word} {word} {word}|{W} and {word} {word}|{w} {word} with {word} {word}|{W}: {word}, {word}, {word}|{W} {word}: {number}, {word} {number}|{W} {word} {number} mg at {date}|{W}, {w} and {word}|The {word} {word} was {word}|No {word} or {word}|Patient is {word} and {word}|Pt {word}, {word} {word}
    {D} {number} mg daily|{D} {number} mg twice daily for {word}|{drug} {number} mg|began {drug} {number} mg because of {word}|hold {drug} if {word}|stop {drug}; begin {drug}|{D} held because of {word}|{D} course ended on day {number}|allergic to {drug}|continue {D} and {D}|{drug} level {number}|on {D} since {date}|gave {D} {number} mL
    Vitals {number}, {number}, T {number}|O2 sat {number} on room air|Hgb {number}, WBC {number}, Plt {number}|Na {number} K {number} Cl {number}|RR {number} SpO2 {number}|weight {number} kg|I/O {number} in, {number} out|pain {number}/10|output {number} mL|EF {number}|size {number} x {number} cm
    CT {word} without contrast|MRI of the {word}|ECG: {word} rhythm|CXR {word} {word}|US {word}: {word}|EKG {word}|chest x-ray {word}|ICU day {number}|OR time {number} minutes|ED course {word}|PT/OT consult|NPO after midnight|DNR/DNI|Bay {number}|Room {number}|Bed {number}|Ward {number}
    {word} {number} {unit}|{W} {number} {unit}, was {number} {unit}|{drug} {number} {unit} given|{drug} {number} {unit} at {date}|{D} {number} {unit} with {word}|{number} {unit} {word} lost|{W} of {number} {unit}, will {word}|{word} above {number} {unit}; {word}|ratio {number} {unit}, {word} pending
    {number} {unit} per day, {word}|{number} {unit}. {W} {word}|{W} {number} {unit}. {W} {word}|{finding} {number} {unit}|{grade} {finding}|{W}: {grade} {finding}|scan: {grade} {region} {finding}|{H}: {grade} {finding}, {grade} {finding}|{region} x-ray: {grade} {finding}, no {finding}|{grade} {region} {finding} since {date}
    CT: {grade} {finding}, {region} {word} normal|{region} {word}: {word} {grade} {finding}|{region} {finding} treated with {drug}|{W} for {region} {finding}|no {finding} or {finding}|with {grade} {finding} and {finding}|{grade} {finding}: {grade} {finding}|by a {word} {word}|with a {word} {word}|{W} with an {grade} {word}
    {region} {word}, {grade} {finding} by {word}|the {region} team {word}|to the {region} clinic|the {region} service follows|seen by {region} surgery|{grade} {word}, {grade} {word}|reviewed with {word} and {word}|seen with {grade} {finding}|signed and {word}|patient with {grade} {finding}|patient: {grade} {word}
    {noun} {number}, {noun} {number}|{H}: {noun} {number}, {noun} {number}, {noun} {grade}|{noun} in {date}|{W} in {date}, {number} {noun}|compared with {date}|{N} since {date}, {noun} {V}|{N}-{noun}, {number} {noun}|Non-{noun}, {V}|{N} {number} hours|{N} shows {grade} {finding}
    {N} {V}|{N} {V}, {word} {noun} {V}|{N} {V} and {noun} {V}|{N} and {noun} {V}|{N} {word}|{N} {grade}, {noun} {word}|{N}: {noun} {V}|{N}: {word}, {noun} {word}|{N} {V} by {noun}|{noun} {V} per {noun}|{N} to {drug}|{N} to be {V}|{N} {V} with {drug}|{N} is {grade}|{N} was {V} for {noun}
    {V} {noun} and {noun}|{V} by {word}|Was {V} with {noun}|Has {V} {noun}|The {noun} {V}|No {noun} {V}|Has {grade} {noun}|{N} of {noun} {V} at {date}|{N} {V} {number} {unit}|will {V} {noun}|{grade} {noun}, {noun} {V}|{N} {word} at {date}, {V} {drug}|Pt {V} {noun}|Patient {V}|Pt is {V}|She {V}|He {V} {noun}
    maternal {finding}, one sibling with {finding}|father with {noun} at {number}, sister with {finding} at {number}|brother has {noun}|sister {V}|husband {V}|wife {V} {noun}|son {V} the {noun}|daughter {V}|mother {V} of {finding}|parents {V}|family {V} about {noun}|wife at work|husband in the {noun} room|friend {V}
    seen by {noun} team, who {V}|Neuro: {word}, {noun} {V}|{H}: {word}, {eponym} sign {word}|{H}: {noun}, {eponym} test {V}|dietitian {V} {noun}|physician {V}|nurse {V} the {noun}|pharmacist {V} {drug}|therapist {V} {noun}|Dr. covering {V}|Dr. to see in clinic|Dr. asked to see|nurse on duty {V}|resident on call {V}
    discussed with {noun}|discussed {noun}|signed {noun}|dictated but not read|called for {noun}|told to {word}|informed of {noun}|updated on {noun}|reviewed {noun} and {noun}|per {noun}|by {noun}|attending to {noun}|provider {V}|author of the {noun}|patient {V}|name of {noun}|pt {V} {drug}|re: {noun}|re {finding}
    {noun} | {number} {unit} | {V}|{N} | {word} | {number}|{H} {N} {V}|{H}\n{N} {V}|{V}\n{N} {word}|{word} {noun}.\n{N} {V}|{noun} {V}. {N} {V} {noun}. {W} {V}|{drug}. {N} {V}|{number} {unit}. {N} {V}|{date}. {N} {V}|at {number}, {noun} {V}|{region} {noun} at {number}, {noun} has {finding}|due to {D}. {N} {V}
    Family present and {word}|family asks about {word}|maternal {word} {word} at age {number}|father died of {word} at {number}|brother with {word}|sister has {word}|wife at bedside|husband at the bedside, {word}|daughter will visit on {date}|son not reachable|partner asks about {word}|friend will drive
    spoke with the family about {word}|spoke to the {word} team|spoke w/ family re: {word}|discussed with the {word} team|d/w patient and family|called the {word} clinic|seen by the {word} team|seen by nutrition|signed by the patient|reviewed by pharmacy|per {word} team|per protocol|per patient
    referred for {word}|referred to {word} clinic|transferred to the {word} unit|discharged to rehab|discharged home|lives alone|lives with family on the second floor|lives in a house with {number} steps|recently moved|walked {number} metres|address {word} at next visit|home with services
    call if {word}|call for {word} above {number}|phone call to family|contact precautions|contact dermatitis|cell count {number}|cell culture {word}|text {word}|mobile with walker|home oxygen {number} L|work of breathing {word}|record reviewed|medical record reviewed|chart reviewed|member of the {word} team
    social work consult|social history: {word}|insurance pending|passport to health class|identity checked|name band checked|street drug use denied|lane change|way better|box of gloves|close follow up|drive to clinic|square wave|court date {date}|place in observation
    {H}:|{H}: {word} {word}|{H} {H}|{H}: none|{H}: {D} {number} mg|{H}: {eponym} disease|admitted on {date}|on {date} at {date}|since {date}|in {M}|last seen {date}|{M} {number}|Monday morning|on Tuesday|by Friday|{date} {date}|repeat in {number} weeks|{number} days ago
    {W} of {word}; {word} {word}|METHODS: {word} {word} in {number} {word}|RESULTS: mean {number} (range {number})|CONCLUSION: {word}|p = {number}|{number} of {number} patients|{W} - {word} - {word}|{W} {w} {word} | {number} | {word}|{drug} | {number} mg | {word}
    This note may contain errors|See {word} sheet|Error in {word}, see {word}|Will {word} and {word}|Plan is {word}|Denies {word}|Reports {word} and {word}|Tolerating {word}|Given {D}|Received {D} {number} units|Consult {word}|Please {word}|Thank you for this {word} consult|Signed electronically
    thought to be {word} by {word}|followed by {word}|caused by {D}|treated by {word}|relieved by {word}|by {date}|w/ {word} and {word}|by {word}, then {word}|from {word} to {word}|of {word} {word}|to {word} by {word}|at {date} by {word}|with {D} and {word}|cc {number} of fluid|name of {word}"""

# Common eponyms and headings.
EPONYMS = (
    "Addison Alport Alzheimer Apgar Babinski Bartter Basedow Bell Bence Berger Braden Brudzinski Burkitt Charcot Cheyne Chvostek Colles Conn Coombs Crohn Cushing Doppler Dupuytren Epstein Ewing Fallot Foley Glasgow Goodpasture Gram "
    "Graves Hashimoto Heimlich Hodgkin Holter Homans Horner Huntington Kaposi Kernig Korsakoff Lachman Marfan Mallory Murphy Osler Paget Parkinson Phalen Pott Raynaud Reye Rinne Romberg Rovsing Sjögren Swan Tinel Tourette "
    "Trendelenburg Trousseau Turner Valsalva Venturi Virchow Weber Wells Wernicke Whipple Wilms Wilson Yankauer"
).split()
HEADINGS = "Assessment|Plan|Impression|History|Allergies|Medications|Past Medical History|Family History|Social History|Physical Exam|Hospital Course|Chief Complaint|Review of Systems|Vital Signs|Labs|Imaging|Disposition|Discharge Diagnosis|Findings|Technique|Indication|Follow-up|Code Status|Access|Neuro|Skin|Abdomen|Lungs|Extremities|Nutrition|Wound Care|Microbiology|Pertinent Results".split("|")

ADVERBS = "again briefly recently today yesterday overnight earlier later twice also now still usually mostly last|week last|month last|year this|week this|morning in|spring two|years|ago by|phone as|before".replace("|", "_").split()
OPENINGS = "||||||Plan:|Note:|Today|Also|Then|At {date}|{W} {word}.|{W} {word} {word}.|{H}:|{number}.|-|Later|Pt {word}.|BP {number}.|Stable overnight.|{word}, {word};|No {word}.|and|Addendum:|{date}|;|("
ENDINGS = (
    ".|.|.|.|||,|;| today.| at {date}.| for {word}.| about {word} {word}.| and {word}.|, {word}.| re: {word}.| on {date}.| with {word} {word}.| - {word}.|; {word} {word}.| in the {word}.| this morning.| who agrees.| overnight, {word} {word}.| {word} {word}.| if {word}.|"
    " when {word}.| as {word}.| to be {word}.| is {word}.| was {word}.| has {word}.| asked for {word}.| again.| checked.| noted.| confirmed by {word}.| once {word}.|; prefers {word}.|, no {word}.|, then {word}.| after {word}.| before {date}.| by {word}.| on arrival.| not {word}.| (see {word}).|\n{H}:|\n{W} {word}.|. {N} {V}.|\n{N} {V}.|; {noun} {V}.| {V} {noun}.| and {V}.| to {V}.| {V}.| {V} {noun} at {date}."
)


def _frames(block: str) -> list[str]:
    return [x.strip() for line in block.strip().splitlines() for x in line.strip().split("|")]


def frames() -> list[tuple[str, str]]:
    """(slot, frame) of all frames; the slot of those without a detail is ''."""
    pairs = [(slot, f) for slot, block in FRAMES.items() for f in _frames(block)]
    # a bar is both the separator and, between blanks, a mark in the text
    return pairs + [("", f) for f in _frames(NOTHING.replace(" | ", " ¦ "))]


def _fill(text: str, d: Draw) -> str:
    """``text`` with its plain slots filled."""
    while (a := text.find("{")) >= 0:
        b = text.index("}", a)
        s = text[a + 1 : b]
        v = {
            "word": d.word, "w": d.word, "W": lambda: d.word().capitalize(), "drug": d.drug, "D": lambda: d.drug().capitalize(), "number": d.number, "V": lambda: d.one(VERBS), "noun": lambda: d.one(NOUNS), "N": lambda: d.one(NOUNS).capitalize(), "unit": d.unit, "finding": d.finding, "grade": lambda: d.one(GRADES), "region": lambda: d.one(REGIONS), "date": d.date, "code": d.code,
            "eponym": lambda: d.one(EPONYMS) if d.r.random() < 0.7 else d.made_up(), "H": lambda: d.one([str.upper, str, str])(d.one(HEADINGS)), "M": lambda: d.one(MONTHS),
        }[s]()
        text = text[:a] + v + text[b + 1 :]
    return text.replace("¦", "|")


def rows(times: int = 5, chosen: list[tuple[str, str]] | None = None, seed: int = 1) -> list[str]:
    """Labelled rows with details written as ``{kind|text}``: every frame ``times`` times with other fillings.

    Frames without a detail are many times shorter than the notes' own plain text, so each comes half as often again.

    ``chosen`` (default: all frames) lets some be held out.
    """
    d, out = Draw(seed), []
    opens, ends = OPENINGS.split("|"), ENDINGS.split("|")
    for k in range(times):
        for slot, frame in [x for x in (frames() if chosen is None else chosen) for _ in range(2 if not x[0] and k % 2 else 1)]:
            opening = d.one(opens)
            body = frame[0].upper() + frame[1:] if opening in ("",) and d.r.random() < 0.5 and not frame.startswith("{") else frame
            before, x, after = body.partition("{x}")
            cue = before.rsplit(" ", 2)
            if len(cue) == 3 and cue[0] and d.r.random() < 0.2:  # "moved to" also reads "moved last year to"
                before = " ".join((cue[0], d.one(ADVERBS).replace("_", " "), *cue[1:]))
            head = _fill((opening + " " if opening not in ("", "(") else opening) + before, d)
            detail = "{" + f"{_KIND[slot]}|{getattr(d, slot)()}" + "}" if x else ""
            out.append(head + detail + _fill(after + d.one(ends), d))
    return out

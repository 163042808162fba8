"""Recall and precision on labelled sentences whose phrases and names the operator was not made for. Items stand in braces."""

import re

from meshwright.llm.pii import PERSONAL, find_pii

LABELLED = [
    "The patient {person_name:Karen Whitfield} was seen again in spring.",
    "Yesterday Mr {person_name:Tobias Lundqvist} rang the site office about the bolts.",
    "Prof. {person_name:Amara Okafor} reviewed the second draft.",
    "Our colleague {person_name:Pieter van der Meer} kept the samples cold.",
    "His sister {person_name:Lucía Ferrández} inherited the notebooks.",
    "Ask the caretaker {person_name:Jonas Weidmann}, phone {phone:+49 30 90182044}, for the key.",
    "Die Kundin {person_name:Annegret Fuchs} bat um Rückruf unter {phone:0151 2345-6789}.",
    "Herr {person_name:Ulrich Brandstetter} wohnt jetzt in der {street_address:Lindengasse 14}.",
    "Frau {person_name:Sabine Köhler-Maas} hat am Montag unterschrieben.",
    "Der Techniker {person_name:Emil Strobl} tauschte das Lager.",
    "Mme {person_name:Odile Garnier} habite {street_address:27, rue Moreau} depuis longtemps.",
    "La locataire {person_name:Hélène Dubreuil} a signalé la fuite.",
    "Monsieur {person_name:Bastien Lefort} peut être joint au {phone:01 42 68 53 00}.",
    "Sra. {person_name:Pilar Montoya} vive en la {street_address:Calle Olmo 8}.",
    "El vecino {person_name:Ramón Iglesias} oyó el ruido.",
    "La paciente {person_name:Inés Valverde} volvió en mayo.",
    "Write to {email:k.whitfield@clinic.example} or {email:post@lundqvist.test}.",
    "Replies go to {email:anne dot smith at office dot example} only.",
    "Reach her at {email:r.iglesias [at] correo [dot] example} after noon.",
    "Fax and voice: {phone:+1 202-555-0147}, mobile {phone:(202) 555-0199}.",
    "Her social security number {id_number:219-09-9999} was on the form.",
    "DNI {id_number:12345678-Z} figura en el contrato.",
    "His insurance number is {id_number:AB 12 34 56 C}.",
    "Deliver it to {street_address:221 Harrow Lane}, second floor.",
    "They moved to {street_address:9 Old Mill Road} last year.",
    "Sie zog in die {street_address:Bergstraße 3b} um.",
    # nobody is meant below
    "The Kalman Filter and the Nelder Mead routine converge at 40 Hz.",
    "Carter Holdings Ltd. supplies the Berlin Works with batch 0049 77 1234.",
    "See EP 1 234 567 B1 and DIN 55350-11, part no. 4711-22-333.",
    "Wilson Road is closed; the Baker Foundation paid for the detour.",
    "Serial 123-456-789 and lot no. 45 were returned to the Hansen Group.",
    "At 12.03.1999 the value was 3.14159265 and the ratio 1:1000000.",
]


def test_recall_and_precision():
    hit = found = wanted = 0
    missed = []
    for line in LABELLED:
        text, want, at = "", set(), 0
        for m in re.finditer(r"\{(\w+):([^}]*)\}", line):
            text += line[at : m.start()]
            want.add((len(text), len(text) + len(m[2]), m[1]))
            text += m[2]
            at = m.end()
        text += line[at:]
        got = {x for x in find_pii(text) if x[2] in PERSONAL}
        hit, found, wanted = hit + len(got & want), found + len(got), wanted + len(want)
        missed += [(k, text[a:b], "missed" if (a, b, k) in want else "wrong") for a, b, k in got ^ want]
    print(f"recall {hit / wanted:.3f}, precision {hit / found:.3f}", missed)
    assert hit / wanted >= 0.9 and hit / found >= 0.9

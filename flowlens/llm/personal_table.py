"""The small labelled table from which the personal-data model is trained: sentences with marked spans."""

from __future__ import annotations

import random

#: Seed and number of lines without any personal data that join the table.
PLAIN_SEED, PLAIN_LINES = 11, 220
#: Frequent words of the four languages, which stand in those lines.
FREQUENT = """the of and to in is that it was for on are with as at be this from or an by not he she you my we they
der die das und ist in mit von zu auf nicht ein eine ich sie es dem den le la les de des et est en un une que qui pour
dans je il elle el los las y es por con para una se no su al""".split()

#: Sentences of four languages. ``<kind>...</kind>`` marks a span; what isn't marked is none.
SENTENCES = """
You can reach me at <email>anna dot miller at example dot org</email> until Friday.
Please write to <email>tom dot hill at example dot com</email> soon.
Ask <email>mary dot white at example dot org</email> today.
Write to <email>j dot smith at mail dot example dot com</email> for details.
My address is <email>peter [at] example [dot] net</email> , thanks.
Contact: <email>sales (at) example (dot) com</email>
Send it to <email>info AT example DOT org</email> before noon.
Schreiben Sie an <email>karl punkt weber at example punkt de</email> bitte.
Meine Adresse ist <email>maria [at] beispiel [punkt] de</email>.
Mon adresse est <email>jean point dupont arobase exemple point fr</email>.
Contactez <email>marie [at] exemple [point] fr</email> pour plus de détails.
Escribe a <email>luis punto perez arroba ejemplo punto es</email> hoy.
Mi correo es <email>carmen [arroba] ejemplo [punto] es</email>.
Call me on <phone>555-123-4567</phone> tomorrow.
Phone: <phone>(212) 555-0198</phone>
My phone number is <phone>415 555 2671</phone>, call any time.
Tel. <phone>020 7946 0958</phone> or visit us.
Please call <phone>0800 555 0199</phone> for help.
Fax: <phone>(030) 555 12 34</phone>, phone: <phone>(030) 555 12 33</phone>.
Mobile <phone>07700 900123</phone> after six.
Telefon: <phone>030 1234567</phone>
Rufen Sie mich an unter <phone>0171 2345678</phone> oder schreiben Sie.
Meine Nummer ist <phone>089/12345678</phone>, bitte anrufen.
Téléphone : <phone>01 23 45 67 89</phone>
Appelez le <phone>06 98 76 54 32</phone> ce matin.
Appelez le <phone>06 12 34 56 78</phone> demain.
Mon numéro est le <phone>04.91.23.45.67</phone>.
Teléfono: <phone>91 123 45 67</phone>
Llama al <phone>612 345 678</phone> por la tarde.
Mi número es <phone>93 456 78 90</phone>, llama cuando quieras.
My card number is <card>4111.1111.1111.1111</card> and it expires soon.
Card: <card>5500/0000/0000/0004</card>
Credit card <card>3400.000000.00009</card> was declined.
Kreditkarte: <card>4012.8888.8888.1881</card>
Carte bancaire : <card>4970.1012.3456.7890</card>
Tarjeta: <card>4532.1488.0343.6467</card>
My name is <person>Anna Miller</person> and I live here.
My name is <person>John</person>.
I spoke with Mr. <person>Smith</person> about the garden.
Dear Mrs. <person>Johnson</person>, thank you for the letter.
We met Mr. <person>Cooper</person> at the station.
She wrote to Mr. <person>Allen</person> about the house.
He spoke to Mrs. <person>Green</person>.
Ask Ms. <person>Clara Jones</person> for the key.
Dr. <person>Robert Brown</person> will see you now.
Name: <person>Peter Clark</person>
Signed by Mr <person>Thomas Wright</person> in the morning.
Patient: <person>Susan Taylor</person>
Ich heiße <person>Karl Weber</person> und wohne hier.
Mein Name ist <person>Sabine Fischer</person>.
Sehr geehrter Herr <person>Schneider</person>, vielen Dank.
Frau <person>Ursula Becker</person> ist nicht da.
Sprechen Sie mit Herrn <person>Wagner</person> darüber.
Je m'appelle <person>Jean Dupont</person> et j'habite ici.
Je m'appelle <person>Paul Lambert</person>.
Je m'appelle <person>Alice</person> et toi ?
Mon nom est <person>Claire Martin</person>.
Madame <person>Sophie Bernard</person> est absente.
Monsieur <person>Petit</person> viendra demain.
Demandez à Mme <person>Durand</person> la clé.
Me llamo <person>Jorge Blanco</person>.
Me llamo <person>Luis Pérez</person> y vivo aquí.
Mi nombre es <person>Carmen Ruiz</person>.
La señora <person>Ana García</person> no está.
El señor <person>Moreno</person> llega mañana.
The river was quiet and the market opened at noon.
Call me later, the phone rang 3 times.
He is at the door and she is at home.
My name is on the list of names.
At 10 the train left; at 12 it came back.
In 1984 the city had 250 000 people.
The card game takes 12 players and 52 cards.
Version 3.1.4 was released on 2021-03-15.
Order 20481 has 3 parts and costs 19.99 dollars.
See page 120, line 45 and table 7.
Licensed under CC BY-NC 4.0.
This work is licensed under the GNU General Public License, version 3.
token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" was found.
Number 9807915762804490 is the serial of the part.
The id 2669109448945250 and the code 4465758382889437 differ.
The meeting is at 10:30 on 12/05/2020 in room 204.
Paris and London are far from New York City.
The Bank of England and the Red Cross met in Geneva.
Thntblere of then, edtioner in inea that esly ndstnd.
Rere that ea is, onerenth edonre ontiatth 5927243074273351 on re.
The dot at the end is a full stop.
Die Stadt hatte 1990 etwa 300000 Einwohner.
Der Herr der Ringe ist ein Buch.
Frau und Mann gehen in den Park.
Am Montag um 14 Uhr beginnt das Spiel.
Die Nummer 12 hat gewonnen, Punkt 3 entfällt.
Enung das chber, der die den lichung er lichäer keit.
La ville avait 120 000 habitants en 1950.
Le nom de la rue est long et le point 4 est clair.
Madame est servie, dit le garçon.
Elle un la, ouréaux qui éoireeau de aiêç ére.
La ciudad tiene 45 calles y 3 plazas.
El señor de la casa no llegó.
Mi nombre no está en la lista, punto 7.
Ciónmento de la, queado los 7536784127813050 asdoie.
Télévision et radio, 24 heures sur 24.
10 01 11 00 10 11 01 00 11
| 12 | 345 | 6789 | 10.5 |
### Title 2: Results ### 99 % of 1000
"""

#: Sentences kept from training, on which the model is tested.
HELD_OUT = """
Please write to <email>susan dot lee at example dot net</email> today.
Mail <email>office [at] example [dot] org</email> now.
Schreiben Sie an <email>otto [at] beispiel [punkt] de</email>.
Call me on <phone>555-987-6543</phone> please.
Phone: <phone>(303) 555-0147</phone>
Telefon: <phone>040 7654321</phone>
Appelez le <phone>07 65 43 21 09</phone> ce soir.
Llama al <phone>698 765 432</phone> mañana.
Card: <card>4000.1234.5678.9010</card>
My name is <person>Emily Stone</person> and I work here.
I spoke with Mr. <person>Baker</person> about it.
Mein Name ist <person>Jonas Vogel</person>.
Je m'appelle <person>Luc Moreau</person>.
Me llamo <person>Elena Torres</person>.
The shop opened at 9 and closed at 17.
In 2001 there were 14 ships and 300 sailors.
Serial 6011000990139424 is on the back.
Of thedly esreon anhe, tieaed haed onhahehe erh.
The old bridge and the new road meet in Vienna.
"""


def plain_lines(seed: int = PLAIN_SEED, lines: int = PLAIN_LINES) -> str:
    """Prose of no language, with capitals, numbers, signs, lists and headings, and no span in it."""
    pick = random.Random(seed)
    letters = "aaeeiioouuäéèñçbcdfghlmnprsttvwyz"

    def word():
        out = "".join(pick.choice(letters) for _ in range(pick.choice((1, 2, 3, 4, 5, 6, 6, 7, 7, 8, 8, 9, 10, 11, 12, 14))))
        if pick.random() < 0.3:
            out = pick.choice(FREQUENT)
        if pick.random() < 0.03:
            out = "".join(pick.choice("0123456789") for _ in range(pick.choice((1, 2, 3, 4, 5, 8, 11, 16, 16, 16, 20))))
        elif pick.random() < 0.02:
            out = f"{pick.randrange(256)}.{pick.randrange(256)}.{pick.randrange(256)}.{pick.randrange(256)}"
        elif pick.random() < 0.02:
            out = f"{out}.{pick.randrange(99)}@mail{pick.randrange(9)}.example.com"
        elif pick.random() < 0.01:
            out = f"+1 ({pick.randrange(100, 999)}) 555-{pick.randrange(1000, 9999)}"
        elif pick.random() < 0.01:
            out = "token = \"" + "".join(pick.choice("0123456789abcdef") for _ in range(40)) + "\""
        return out

    out = []
    for _ in range(lines):
        style, row, capital = pick.randrange(12), [], True
        for _ in range(pick.randrange(3, 16)):
            x = word()
            if style == 3 and row and pick.random() < 0.7:
                row.append(row[-1])
                continue
            x = x.upper() if style == 0 else x.capitalize() if capital or pick.random() < 0.08 else x
            end = pick.random()
            capital = end < 0.2
            row.append(x + ("!!" if style == 0 else " |" if style == 1 else pick.choice(("***", "%%%", "$$$", "###", "&&&")) if style == 2
                            else "." if capital else "," if end < 0.32 else ""))
        out.append(" ".join(row) + ".")
    return "\n".join(out)

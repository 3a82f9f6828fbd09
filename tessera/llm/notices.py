"""Licence notices, ordinary words, and the labelled sample that op3's models are trained on."""

from __future__ import annotations

import random
import re

TOKEN = r"[a-z]+|[0-9]+(?:\.[0-9]+)?"
#: What is left out of a version number.
NOUGHT = r"([0-9])\.0(?![0-9]|\.[0-9])"
#: Variants of each name and passage, made-up names, ordinary sentences.
VARIANTS, MADE_UP, ORDINARY = 9, 500, 1_500

# Names of licences by family, as notices give them.
NAMES = {
    "mit": ["the MIT License", "MIT/X11", "the MIT licence", "MIT-Lizenz", "la licencia MIT", "licence MIT"],
    "isc": ["the ISC License", "ISC"],
    "bsd": ["the BSD 3-Clause License", "the BSD 2-Clause License", "the Simplified BSD License", "the New BSD License", "BSD-3-Clause", "BSD-Lizenz", "licence BSD", "la licencia BSD"],
    "zlib": ["the zlib License", "the zlib/libpng License"],
    "bsl-1.0": ["the Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "apache-1.1": ["the Apache Software License, Version 1.1", "Apache 1.1"],
    "apache-2.0": ["the Apache License, Version 2.0", "Apache 2.0", "Apache-2.0", "der Apache-Lizenz, Version 2.0", "der Apache 2.0", "la licencia Apache 2.0", "licence Apache 2.0"],
    "gpl-2.0": ["the GNU General Public License, version 2", "the GNU General Public License version 2 or later", "GPL version 2", "GPL 2.0", "GPL-2.0", "GPLv2", "der GNU General Public License Version 2", "la licencia GPL 2.0", "licence GPL version 2"],
    "gpl-3.0": ["the GNU General Public License, version 3", "the GNU General Public License version 3 or later", "GPL version 3", "GPL 3.0", "GPL-3.0", "GPLv3", "der GNU General Public License Version 3", "la licencia GPL 3.0", "licence GPL version 3"],
    "agpl-3.0": ["the GNU Affero General Public License, version 3", "the GNU Affero General Public License", "AGPL 3.0", "AGPLv3", "Affero GPL 3", "Affero GPL version 3"],
    "lgpl": ["the GNU Lesser General Public License", "the GNU Lesser General Public License version 2.1", "the GNU Lesser General Public License, version 3", "LGPL 2.1", "LGPL 3.0", "LGPLv3", "the GNU Library General Public License"],
    "mpl-1.1": ["the Mozilla Public License, version 1.1", "MPL 1.1"],
    "mpl-2.0": ["the Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0"],
    "epl-1.0": ["the Eclipse Public License, version 1.0", "EPL 1.0"],
    "epl-2.0": ["the Eclipse Public License, version 2.0", "EPL 2.0"],
    "artistic-2.0": ["the Artistic License 2.0", "the Artistic License, version 2.0"],
    "ofl-1.1": ["the SIL Open Font License, Version 1.1", "OFL 1.1"],
    "gfdl": ["the GNU Free Documentation License", "the GNU Free Documentation License, version 1.3", "GFDL 1.3"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "a Creative Commons Attribution 4.0 International License", "CC BY 3.0", "Creative Commons Attribution 3.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "a Creative Commons Attribution ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "a Creative Commons Attribution NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 3.0"],
    "cc-by-nd": ["CC BY-ND 4.0", "CC-BY-ND-4.0", "a Creative Commons Attribution NoDerivatives 4.0 International License"],
    "cc-by-nc-sa": ["CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", "a Creative Commons Attribution NonCommercial ShareAlike 4.0 International License"],
    "cc-by-nc-nd": ["CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0", "a Creative Commons Attribution NonCommercial NoDerivatives 4.0 International License"],
    "cc0": ["CC0 1.0", "CC0", "CC0 1.0 Universal"],
    "unlicense": ["the Unlicense"],
}
# Notices that stand alone, and passages of licence texts, by family.
PASSAGES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind"],
    "gpl-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0. If a copy of the MPL was not distributed with this file, you can obtain one"],
    "cc0": ["Released under CC0 1.0 into the public domain.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work; dedicated to the public domain."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "all-rights-reserved": [
        "All rights reserved.", "Copyright by the author. All rights reserved. No part may be reproduced without permission.", "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher",
        "Alle Rechte vorbehalten.", "Todos los derechos reservados.", "Tous droits réservés.",
    ],
}
# What notices say before a licence's name.
CARRIERS = (
    "Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "Distributed under the terms of {}.", "This program is licensed under {}.", "Code is available under {}.", "{}", "{}", "License: {}",
    "Lizenziert unter {}.", "Veröffentlicht unter {}.", "Licenciado bajo {}.", "Publicado bajo {}.", "Sous licence {}.", "Publié sous {}.",
)
# Names of licences outside the families, for the calibration of the unknown class alone.
OUTSIDE = (
    "the Common Development and Distribution License, version 1.0", "the Common Public License Version 1.0", "the Open Software License 3.0", "the Server Side Public License, version 1", "the Business Source License 1.1",
    "the Python Software Foundation License", "the Ruby License", "the Vim License", "the European Union Public Licence, version 1.2", "the Academic Free License 3.0", "the Elastic License 2.0", "the Microsoft Public License",
    "the PostgreSQL License", "the PHP License, version 3.01", "the LaTeX Project Public License, version 1.3c", "the Open Data Commons Open Database License 1.0", "the IBM Public License Version 1.0", "the Do What The Fuck You Want To Public License",
)
# Words of the made-up names of unknown licences, and of ordinary sentences.
_MADE = "acme orbit harbor north cedar falcon delta summit river quantum maple granite vector lumen atlas copper zephyr willow nova polar custom internal company vendor partner evaluation academic trial shareware donation".split()
_PLAIN = (
    "the a of to and in is was for on with as by at from his her their it this that which driver driving fishing dog office city court judge new old state council renewed applied paid fee holder expired bar shop music film book author page "
    "license licence licensed copyright law rights human reserved seats table released under water public domain name permission granted visitors software house report article year people said first may use file terms version "
    "he she they we you not no but or if when who what where there here more most some any all one two three four time day week month world country government company market money work life home school system number part place case point "
    "der die das und ist nicht mit für ein eine auf dem von zu sich des den im als auch es an werden aus hat dass nach wird bei noch wie einem über el la los las de que y en un una por con para se del al lo como más pero sus le ya "
    "les des est pas dans qui sur au avec il ce plus par je tout mais nous sont aux leur été fait comme free source code copy library general program open science text data research model foundation study"
).split()
# Words that say nothing alone; no feature consists of them only.
FUNCTION = frozenset(
    "the a an of to and in is was were for on with without as by at from his her their it its this that these those which be been are or if not no any all you we he she they may can has have had do does will would shall can must such other into out there here what who when where "
    "der die das und ist nicht mit für ein eine einem einen auf dem den von zu sich des im als auch es an aus dass nach bei wie über el la los las de que y en un una por con para se del al lo como más pero sus le les est pas dans qui sur au aux avec il ce plus par je tout mais nous sont leur et ou du r s l d qqq".split()
)


def words_of(text: str) -> list[str]:
    """Letters and numbers of a text, lower-cased; 3.0 is 3."""
    return re.findall(TOKEN, re.sub(NOUGHT, r"\1", text.lower()))


def templates() -> list[tuple[str, list[str], bool]]:
    """(family, words, whether a passage) of every name and passage."""
    names = [(family, words_of(name.removeprefix("the ").removeprefix("a ")), False) for family, given in NAMES.items() for name in given]
    return names + [(family, words_of(p), True) for family, given in PASSAGES.items() for p in given]


FAMILIES = tuple(dict.fromkeys([*NAMES, *PASSAGES]))
CLASSES = (*FAMILIES, "unknown", "none")


def _noise(rng: random.Random, counts: tuple[int, ...]) -> list[str]:
    """Ordinary words, some or most of them (``qqq``) such as no notice and no list here has."""
    rare = rng.choice((0.0, 0.5, 0.9))
    return ["qqq" if rng.random() < rare else w for w in rng.choices(_PLAIN, k=rng.choice(counts))]


def _made_up(rng: random.Random) -> str:
    name = " ".join(rng.choices(_MADE, k=rng.randint(1, 3)))
    kind = rng.choice(("public license", "license", "licence", "software license", "source license", "license agreement", "community license", "free license", "general license"))
    return f"{rng.choice(('the ', 'a ', ''))}{name} {kind}{rng.choice(('', '', f' {rng.randint(1, 5)}', f' version {rng.randint(1, 5)}', f' {rng.randint(1, 4)}.{rng.randint(1, 9)}'))}"


def notices(rng: random.Random, given: list[tuple[str, str]], variants: int) -> list[tuple[list[str], str]]:
    """Labelled word lists: variants of (family, name) in some carrier, amid other words."""
    rows = []
    for family, name in given:
        for _ in range(variants):
            words = words_of(rng.choice(CARRIERS).format(name))
            rows.append((_noise(rng, (0, 0, 0, 1, 4)) + words + _noise(rng, (0, 0, 0, 2, 8, 30)), family))
    return rows


def sample(seed: int) -> list[tuple[list[str], str]]:
    """Labelled word lists: notices by family, notices of made-up licences, ordinary sentences."""
    rng = random.Random(seed)
    rows = notices(rng, [(f, n) for f, given in NAMES.items() for n in given], VARIANTS)
    for family, given in PASSAGES.items():
        for words in map(words_of, given):
            for _ in range(4 * VARIANTS):
                n = rng.randint(min(7, len(words)), len(words))
                at = rng.randint(0, len(words) - n)
                kept = [w for w in words[at : at + n] if rng.random() > 0.04 or n < 8]
                rows.append((_noise(rng, (0, 0, 1, 4)) + kept + _noise(rng, (0, 0, 2, 8)), family))
    rows += [row for _ in range(MADE_UP) for row in notices(rng, [("unknown", _made_up(rng))], 1)]
    loose = [w for _, words, _ in templates() for w in words]
    for _ in range(ORDINARY):  # some with words of notices, out of their order
        words = _noise(rng, (1, 3, 10, 30, 90))
        words += rng.choices(loose, k=rng.randint(0, len(words) // 3))
        rng.shuffle(words)
        rows.append((words, "none"))
    return rows

"""What the licence classifier is trained on: families, the words they are granted in, and paragraphs that grant nothing.

All fixed values: names, notices and clauses as their publishers have them, in natural order.
"""

from __future__ import annotations

#: Fixed values. Family (its SPDX identifier) -> names that works give it.
NAMES = {
    "agpl-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL, version 3", "AGPLv3"),
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0"),
    "artistic-2.0": ("Artistic License 2.0",),
    "bsd-2-clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "bsd-3-clause": ("BSD 3-Clause License", "New BSD License", "BSD-style license"),
    "bsl-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "cc-by-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "cc-by-nc-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-nc-sa-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "cc-by-nd-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "cc-by-sa-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc0-1.0": ("CC0 1.0", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero 1.0"),
    "cddl-1.0": ("Common Development and Distribution License 1.0", "CDDL 1.0"),
    "epl-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v. 2.0", "EPL 2.0"),
    "eupl-1.2": ("European Union Public License 1.2", "EUPL 1.2"),
    "gpl-2.0": ("GNU General Public License, version 2", "GNU GPL, version 2", "GPL version 2", "GPLv2"),
    "gpl-3.0": ("GNU General Public License, version 3", "GNU GPL, version 3", "GPL version 3", "GPLv3"),
    "isc": ("ISC License",),
    "lgpl-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL, version 2.1", "LGPLv2.1"),
    "lgpl-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL, version 3", "LGPLv3"),
    "mit": ("MIT License", "Expat License"),
    "mpl-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "ofl-1.1": ("SIL Open Font License, Version 1.1", "OFL 1.1"),
    "psf-2.0": ("Python Software Foundation License 2.0", "PSF License 2.0"),
    "unlicense": ("The Unlicense", "Unlicense"),
    "wtfpl": ("Do What The F*ck You Want To Public License", "WTFPL"),
    "zlib": ("zlib License", "zlib/libpng License"),
}

#: Fixed values. Paragraphs of licences and of the notices that files carry.
TEXTS = {
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "bsd-2-clause": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "bsl-1.0": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    ),
    "cc0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    ),
    "cddl-1.0": (
        'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License.',
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    "eupl-1.2": (
        'Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the "Licence"); You may not use this work except in compliance with the Licence.',
    ),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "lgpl-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "ofl-1.1": ("This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at: https://openfontlicense.org",),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "wtfpl": ("This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The F*ck You Want To Public License, Version 2, as published by Sam Hocevar.",),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
}

#: Fixed values. Sentences that grant a licence by its name, and ones that don't.
GRANTS = (
    "Licensed under the {}.",
    "Licensed under {}.",
    "Released under the {}.",
    "Released under {}.",
    "This software is licensed under the {}.",
    "This work is licensed under a {}.",
    "This work is licensed under the {}.",
    "Distributed under the terms of the {}.",
    "This project is distributed under {}.",
    "License: {}",
    "This project is made available under the {}, see the LICENSE file.",
    "Use of this file is governed by the {}.",
    "Published under the {} by its authors.",
    "Available under the terms of the {}.",
)
MENTIONS = (
    "In class we compared the {} with other licenses.",
    "The {} was written by lawyers who wanted to keep it short.",
    "Last year the company moved away from the {}.",
    "A book about the {} costs ten euros.",
    "Is the {} good enough for a small business?",
    "They wrote about the history of the {} and its critics.",
)
#: Kept out of training.
HELD_GRANTS = ("The code in this repository is released under the {}.", "You may use and share this file under the terms of the {}.", "This library is available under the {}.")
HELD_MENTIONS = ("She asked in the meeting what the {} says about patents.", "Some people dislike the {} because it is long.")

#: Fixed values. Licences that aren't among the families.
FOREIGN = (
    "Acme Public License, version 4", "Affine Research License 1.3", "Common Public Attribution License 1.0", "Cryptix General License", "Frameworx License 1.0", "Fair Use Community License 5",
    "Jabber Open Source License", "Lucent Public License 1.02", "Nokia Open Source License", "Open Government Licence 3.0", "Ricoh Source Code Public License", "Sleepycat License", "Vovida Software License 1.0", "company's internal license",
)

#: Fixed values. Paragraphs with the words of licences that are none.
OTHERS = (
    "She got her driving licence in the spring and drove to the coast.",
    "Nobody may enter the building without permission from the office.",
    "Copyright law has changed several times in the last century.",
    "The council renewed the licence of the restaurant for two years.",
    "All rights reserved. Copyright of the photographs stays with their owners.",
    "The treaty redistributes the catch between the two countries.",
    "The house stands on land in the public domain near the river.",
    "A fishing license costs less for residents of the county.",
    "He asked for permission to leave the table before the others.",
    "Software vendors sell licenses by the seat or by the year.",
    "The version of the story that was published is not the first.",
    "They signed a license agreement with the publisher of the book.",
    "No part of this publication may be reproduced, stored or transmitted in any form without the prior written permission of the publisher.",
    "By installing the software you accept the terms of this end user license agreement. The software is licensed, not sold.",
    "This software and its documentation are confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    "Licenses are granted to members only and are not transferable under any conditions.",
    "The warranty covers defects in material and workmanship for two years and is provided in addition to your rights under applicable law.",
    "You can redistribute the leaflets freely, the office has printed more copies for any purpose.",
)

"""Notices of licence families, in the wordings that are in common use.

Fixed values: these sentences are what a licence's own text, or its customary notice, says.
"""

FAMILIES = {
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Licensed under the MIT License. See LICENSE file in the project root for full license information.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL v2.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "You may not use the material for commercial purposes.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "This work has been dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) the authors. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
    ],
}

# Notices of licences that are no family here, and sentences that only look like notices.
# Every second one trains, the others calibrate.
NEAR_NOTICES = [
    "Licensed under the Zlib License. See LICENSE file in the project root for full license information.",
    "Licensed under the ISC License. See LICENSE file in the project root for full license information.",
    "Released under the ISC License.",
    "Released under the Zlib License.",
    "Licensed under the Boost Software License, Version 1.0.",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the Eclipse Public License, Version 2.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "This project is licensed under the terms of the ISC license.",
    "This project is licensed under the terms of the Artistic License.",
    "Released under the Artistic License 2.0.",
    "Released under the Unlicense.",
    "This work is licensed under the GNU Free Documentation License, version 1.3.",
    "This work is licensed under the Open Font License, version 1.1.",
    "SPDX-License-Identifier: ISC",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: BSL-1.0",
    "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: Artistic-2.0",
    "SPDX-License-Identifier: OFL-1.1",
    "Licensed under the Common Development and Distribution License, version 1.0.",
    "Licensed under the Academic Free License, version 3.0.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "The copyright notices in the Software and this entire statement must be included in all copies of the Software, in whole or in part",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "provided that the above copyright notice and this permission notice appear in all copies",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
    "This program is distributed with a manual that you can redistribute to your friends.",
    "All rights of the workers are reserved for a later meeting.",
    "She was released under the terms of the new law.",
    "You may obtain a copy of the report at the town hall.",
    "The rights to use the road in the public interest.",
    "Licensed under the Python License, Version 2.0.",
    "Licensed under the Elastic License, Version 2.0.",
    "Released under the Python 2.0 license.",
    "Released under the Perl license.",
]

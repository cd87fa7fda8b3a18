"""Texts of public licences, and of the notices that the long ones ask to be put into files."""

WARRANTY_MIT = """
The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of
merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for
any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with
the software or the use or other dealings in the software.
"""

MIT = (
    """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions
of the Software.
"""
    + WARRANTY_MIT
)

ISC = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. The software is provided "as is" and the author disclaims all
warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be
liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits,
whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of
this software.
"""

BSD = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission.
This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not
limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the
copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including,
but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused
and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out
of the use of this software, even if advised of the possibility of such damage.
"""

ZLIB = """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not
be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in
the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must
not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.
"""

BOOST = """
Boost Software License - Version 1.0 - August 17th, 2003. Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in
part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable
object code generated by a source language processor. The software is provided "as is", without warranty of any kind, express or implied,
including but not limited to the warranties of merchantability, fitness for a particular purpose, title and non-infringement. In no event
shall the copyright holders or anyone distributing the software be liable for any damages or other liability, whether in contract, tort
or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.
"""

UNLICENSE = (
    """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in
the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
software under copyright law.
"""
    + WARRANTY_MIT
)

APACHE = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
or implied. See the License for the specific language governing permissions and limitations under the License.
"""

GPL = """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along
with this program. If not, see http://www.gnu.org/licenses/
"""

LGPL = """
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser
General Public License along with this library; if not, write to the Free Software Foundation.
"""

AGPL = """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero
General Public License along with this program. If not, see http://www.gnu.org/licenses/
"""

MPL = """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""

CC0 = """
To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. The person who
associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide
under copyright law, including all related and neighboring rights, to the extent allowed by law. You can copy, modify, distribute and
perform the work, even for commercial purposes, all without asking permission. CC0 1.0 Universal
"""

EPL = """
This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this
distribution, and is available at https://www.eclipse.org/legal/epl-2.0/
"""

CDDL = """
The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use
this file except in compliance with the License. See the License for the specific language governing permissions and limitations under
the License. When distributing Covered Code, include this CDDL HEADER in each file and include the License file. If applicable, add the
following below this CDDL HEADER, with the fields enclosed by brackets replaced with your own identifying information.
"""

ARTISTIC = """
This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0. Any use,
modification, and distribution of the Standard or Modified Versions is governed by this Artistic License. By using, modifying or
distributing the Package, you accept this license. Do not use, modify, or distribute the Package, if you do not accept this license.
"""

CC = "licensed under CC BY-NC 4.0. This work is licensed under a Creative Commons Attribution license"

#: By label: the text, and phrases of which one must stand in the file.
TEMPLATES = {
    "mit": (MIT, ("permission is hereby granted free of charge", "mit license")),
    "apache": (APACHE, ("apache license",)),
    "gpl": (GPL, ("gnu general public license",)),
    "lgpl": (LGPL, ("lesser general public license",)),
    "agpl": (AGPL, ("affero general public license",)),
    "bsd": (BSD, ("redistribution and use in source and binary forms", "bsd license")),
    "mpl": (MPL, ("mozilla public license",)),
    "isc": (ISC, ("permission to use copy modify and or distribute", "isc license")),
    "zlib": (ZLIB, ("altered source versions must be plainly marked",)),
    "boost": (BOOST, ("boost software license",)),
    "unlicense": (UNLICENSE, ("free and unencumbered software",)),
    "cc": (CC, ("licensed under cc", "creative commons")),
    "cc0": (CC0, ("waived all copyright and related or neighboring rights", "dedicated the work to the public domain", "cc0 1 0 universal")),
    "epl": (EPL, ("eclipse public license",)),
    "cddl": (CDDL, ("common development and distribution license",)),
    "artistic": (ARTISTIC, ("artistic license",)),
}

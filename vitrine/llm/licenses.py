"""License scans by ordered signature rules; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.shared import fresh

#: What lies between words (all ASCII but letters and digits); the rest of Unicode is in words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The phrases that always count, and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


@dataclass(frozen=True)
class Rule:
    """A signature: a regex over lower-case words with single blanks between them.

    `keyword` is a text that every match holds. Of rules that match the same words, the one that
    stands first wins; `trust` (0 to 1) says how sure a match is.
    """

    label: str
    keyword: str
    pattern: str
    trust: float


#: Families of licenses as (label, keyword, name as a regex, versions as written).
VERSIONED = (
    ("gpl", "gnu general public licen", r"gnu general public licen[sc]e", ("1", "2", "3")),
    ("lgpl", "lesser general public licen", r"(?:gnu )?lesser general public licen[sc]e", ("2 1", "3")),
    ("lgpl", "library general public licen", r"(?:gnu )?library general public licen[sc]e", ("2",)),
    ("agpl", "affero general public licen", r"(?:gnu )?affero general public licen[sc]e", ("1", "3")),
    ("gfdl", "free documentation licen", r"(?:gnu )?free documentation licen[sc]e", ("1 1", "1 2", "1 3")),
    ("apache", "apache", r"apache (?:software )?licen[sc]e", ("1 0", "1 1", "2 0")),
    ("mpl", "mozilla public licen", r"mozilla public licen[sc]e", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse public licen", r"eclipse public licen[sc]e", ("1 0", "2 0")),
    ("eupl", "european union public licen", r"european union public licen[sc]e", ("1 0", "1 1", "1 2")),
    ("cddl", "common development and distribution licen", r"common development and distribution licen[sc]e", ("1 0", "1 1")),
    ("cpl", "common public licen", r"common public licen[sc]e", ("0 5", "1 0")),
    ("artistic", "artistic licen", r"(?:perl )?artistic licen[sc]e", ("1 0", "2 0")),
    ("bsl", "boost software licen", r"boost software licen[sc]e", ("1 0",)),
    ("afl", "academic free licen", r"academic free licen[sc]e", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("osl", "open software licen", r"open software licen[sc]e", ("1 0", "1 1", "2 0", "2 1", "3 0")),
    ("ofl", "open font licen", r"(?:sil )?open font licen[sc]e", ("1 0", "1 1")),
    ("odbl", "open database licen", r"open database licen[sc]e", ("1 0",)),
    ("php", "php licen", r"php licen[sc]e", ("3 0", "3 01")),
    ("zpl", "zope public licen", r"zope public licen[sc]e", ("1 1", "2 0", "2 1")),
    ("ms-pl", "microsoft public licen", r"microsoft public licen[sc]e", ("1 0",)),
    ("ms-rl", "microsoft reciprocal licen", r"microsoft reciprocal licen[sc]e", ("1 0",)),
    ("qpl", "q public licen", r"q public licen[sc]e", ("1 0",)),
    ("ecl", "educational community licen", r"educational community licen[sc]e", ("1 0", "2 0")),
    ("wtfpl", "do what the fuck you want to public licen", r"do what the fuck you want to public licen[sc]e", ("1 0", "2 0")),
    ("cecill", " cecill ", r"cecill (?:free software )?licen[sc]e", ("1 0", "1 1", "2 0", "2 1")),
)

#: Short identifiers as (label, first word, versions); a suffix may follow. The
#: version may be joined to the word ("GPLv3", "LGPLv2.1") or stand behind "v" or "version".
IDENTIFIERS = (
    ("gpl", "gpl", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("lgpl", "lgpl", ("2 0", "2 1", "3 0", "2", "3")),
    ("agpl", "agpl", ("1 0", "3 0", "1", "3")),
    ("gfdl", "gfdl", ("1 1", "1 2", "1 3")),
    ("apache", "apache", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", "epl", ("1 0", "2 0")),
    ("eupl", "eupl", ("1 0", "1 1", "1 2")),
    ("cddl", "cddl", ("1 0", "1 1")),
    ("artistic", "artistic", ("1 0", "2 0")),
    ("bsl", "bsl", ("1 0",)),
    ("afl", "afl", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("osl", "osl", ("1 0", "1 1", "2 0", "2 1", "3 0")),
    ("ofl", "ofl", ("1 0", "1 1")),
    ("odbl", "odbl", ("1 0",)),
    ("zpl", "zpl", ("1 1", "2 0", "2 1")),
    ("ecl", "ecl", ("1 0", "2 0")),
    ("cecill", "cecill", ("1 0", "1 1", "2 0", "2 1")),
)

#: Parts of Creative Commons names, and the versions of those licenses.
COMMONS = (
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s?"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by", "by", "attribution"),
)
COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: Sentences and names that stand for one license, as (label, keyword, regex, trust).
PHRASES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?", 1.0),
    ("mit", "the above copyright notice and this permission notice", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software", 1.0),
    ("apache", "you may not use this file except in compliance with the license", "you may not use this file except in compliance with the license", 1.0),
    ("apache", "unless required by applicable law or agreed to in writing", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 1.0),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 1.0),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 1.0),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software", "all advertising materials mentioning features or use of this software must display the following acknowledgement", 1.0),
    ("gpl", "this program is free software", "this program is free software you can redistribute it and or modify it under the terms of(?= the gnu general public licen[sc]e)", 1.0),
    ("lgpl", "this library is free software", "this library is free software you can redistribute it and or modify it under the terms of(?= the gnu (?:lesser|library) general public licen[sc]e)", 1.0),
    ("agpl", "this program is free software", "this program is free software you can redistribute it and or modify it under the terms of(?= the gnu affero general public licen[sc]e)", 1.0),
    ("mpl", "if a copy of the mpl was not distributed with this file", "if a copy of the mpl was not distributed with this file you can obtain one at", 1.0),
    ("epl", "this program and the accompanying materials are made available", "this program and the accompanying materials are made available under the terms of(?= the eclipse public licen[sc]e)", 1.0),
    ("bsl", "permission is hereby granted free of charge to any person or organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 1.0),
    ("zlib", "the origin of this software must not be misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", 1.0),
    ("zlib", "altered source versions must be plainly marked as such", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 1.0),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy modify publish use compile sell or distribute this software", 1.0),
    ("cc0", "has waived all copyright and related or neighboring rights", "has waived all copyright and related or neighboring rights", 1.0),
    ("ofl", "the font software may be sold as part of a larger software package", "the font software may be sold as part of a larger software package", 0.9),
    ("wtfpl", "you just do what the fuck you want to", "you just do what the fuck you want to", 1.0),
    ("mit", "mit licen", "(?:the )?mit(?: x11| expat)? licen[sc]e", 0.9),
    ("mit", "expat licen", "expat licen[sc]e", 0.9),
    ("mit", "x11 licen", "x11 licen[sc]e", 0.8),
    ("mit", "licensed under ", "licensed under (?:the )?mit", 0.8),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("bsd", "neither the name of", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse", 0.9),
    ("bsd-3-clause", " bsd 3 clause ", "bsd 3 clause(?: licen[sc]e)?", 1.0),
    ("bsd-2-clause", " bsd 2 clause ", "bsd 2 clause(?: licen[sc]e)?", 1.0),
    ("bsd-3-clause", " clause bsd ", "(?:3|three) clause bsd(?: licen[sc]e)?", 1.0),
    ("bsd-2-clause", " clause bsd ", "(?:2|two) clause bsd(?: licen[sc]e)?", 1.0),
    ("bsd-4-clause", " clause bsd ", "(?:4|four) clause bsd(?: licen[sc]e)?", 1.0),
    ("bsd", "bsd licen", "(?:new |modified |simplified |revised )?bsd licen[sc]e", 0.9),
    ("isc", "isc licen", "isc licen[sc]e", 0.9),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee", 1.0),
    ("zlib", " zlib ", "zlib(?: libpng)? licen[sc]e", 0.9),
    ("zlib", "this software is provided as is without any express or implied warranty", "this software is provided as is without any express or implied warranty in no event", 0.8),
    ("unlicense", "unlicense", "(?:the )?unlicense", 0.8),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain", 1.0),
    ("public-domain", "public domain", "(?:released|dedicated|placed) (?:in|in to|into|to) the public domain", 0.7),
    ("cc0", " cc0 ", "cc0(?: 1 0)?(?: universal)?", 0.9),
    ("cc0", "creative commons zero", "creative commons zero", 0.9),
    ("beerware", "beer ware licen", "(?:the )?beer ware licen[sc]e", 0.9),
    ("all-rights-reserved", "all rights reserved", "all rights reserved", 0.5),
    ("proprietary", "proprietary and confidential", "proprietary and confidential", 0.7),
    ("proprietary", "end user licen", "end user licen[sc]e agreement", 0.7),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", 0.3),
    ("creative-commons", "creative commons", "creative commons(?: licen[sc]e)?", 0.4),
    ("gpl", " gpl ", "(?:gnu )?gpl", 0.6),
    ("lgpl", " lgpl ", "(?:gnu )?lgpl", 0.6),
    ("agpl", " agpl ", "(?:gnu )?agpl", 0.6),
)

#: Sentences of licenses and of exceptions to them, as (label, keyword, regex).
SENTENCES = (
    ("mit", "the software is provided as is without warranty of any kind", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", "to deal in the software without restriction", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "in an action of contract tort or otherwise arising from", "whether in an action of contract tort or otherwise arising from out of or in connection with the software"),
    ("mit-0", "to permit persons to whom the software is furnished to do so the software is provided", "to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("x11", "shall not be used in advertising or otherwise to promote the sale", "the name of .{1,80}? shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("isc", "the author disclaims all warranties with regard to this software", "the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("isc", "the software is provided as is and", "the software is provided as is and .{1,60}? disclaims all warranties with regard to this software"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd", "this software is provided by the copyright holders and contributors", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd", "this software is provided by the regents and contributors", "this software is provided by the regents and contributors as is and any express or implied warranties"),
    ("bsd", "in no event shall the copyright", "in no event shall the copyright (?:holder|owner)s? or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd-3-clause-clear", "no express or implied licenses to any party s patent rights", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-4-clause", "this product includes software developed by", "this product includes software developed by(?: the)? [^ ]+(?: [^ ]+){0,8}?(?= and its contributors)"),
    ("bsd-2-clause-views", "the views and conclusions contained in the software", "the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies"),
    ("apache-2.0", "licensed under the apache license", "licensed under the apache license version 2 0 the license"),
    ("apache", "see the license for the specific language governing permissions", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache", "you may obtain a copy of the license at", "you may obtain a copy of the license at (?:https? )?www apache org licenses license 2 0"),
    ("apache", "terms and conditions for use reproduction and distribution", "terms and conditions for use reproduction and distribution 1 definitions license shall mean"),
    ("apache", "licensed to the apache software foundation", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", "this product includes software developed by the apache software foundation", "this product includes software developed by the apache software foundation"),
    ("apache-1.1", "products derived from this software may not be called apache", "products derived from this software may not be called apache nor may apache appear in their name"),
    ("llvm-exception", "llvm exceptions to the apache", "llvm exceptions to the apache 2 0 license"),
    ("llvm-exception", "with llvm exceptions", "with llvm exceptions"),
    ("gpl", "this program is distributed in the hope that it will be useful", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of"),
    ("gpl", "you should have received a copy of the gnu general public license", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "the licenses for most software", "the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", "each time you redistribute the program", "each time you redistribute the program or any work based on the program the recipient automatically receives a license"),
    ("gpl-3", "the gnu general public license is a free copyleft license", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3", "basic permissions all rights granted under this license", "basic permissions all rights granted under this license are granted for the term of copyright on the program"),
    ("gpl-3", "conveying under any other circumstances is permitted solely", "conveying under any other circumstances is permitted solely under the conditions stated below"),
    ("classpath-exception", "linking this library statically or dynamically", "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("classpath-exception", "regardless of the license terms of these independent modules", "as a special exception the copyright holders of this library give you permission to link this library with independent modules to produce an executable regardless of the license terms of these independent modules"),
    ("gcc-exception", "gcc runtime library exception", "gcc runtime library exception(?: version 3 1)?"),
    ("gcc-exception", "you have permission to propagate a work of target code", "you have permission to propagate a work of target code formed by combining the runtime library with independent modules"),
    ("bison-exception", "you may create a larger work that contains part or all of the bison parser skeleton", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("autoconf-exception", "configuration script generated by autoconf", "(?:if you distribute this file as part of a program that contains a )?configuration script generated by autoconf"),
    ("openssl-exception", "permission to link the code of", "permission to link the code of .{1,80}? with the openssl (?:project s openssl )?library"),
    ("linux-syscall-note", "user programs that use kernel services by normal system calls", "this copyright does not cover user programs that use kernel services by normal system calls"),
    ("font-exception", "if you create a document which uses this font", "if you create a document which uses this font and embed this font or unaltered portions of this font into the document"),
    ("lgpl", "this library is distributed in the hope that it will be useful", "this library is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license", "you should have received a copy of the gnu lesser general public license along with this (?:library|program)"),
    ("lgpl", "incorporates the terms and conditions of version 3 of the gnu general public license", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl", "remote network interaction", "remote network interaction use with the gnu general public license"),
    ("agpl", "you should have received a copy of the gnu affero general public license", "you should have received a copy of the gnu affero general public license along with this program"),
    ("agpl", "if you modify the program your modified version must prominently offer", "if you modify the program your modified version must prominently offer all users interacting with it remotely"),
    ("gfdl", "permission is granted to copy distribute and or modify this document", "permission is granted to copy distribute and or modify this document under the terms of(?= the gnu free documentation license)"),
    ("gfdl", "with no invariant sections", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "incompatible with secondary licenses", "this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.1", "alternatively the contents of this file may be used under the terms of", "alternatively the contents of this file may be used under the terms of either"),
    ("npl", "the contents of this file are subject to the netscape public license", "the contents of this file are subject to the netscape public license"),
    ("cddl", "the contents of this file are subject to the terms of the common development", "the contents of this file are subject to the terms of(?= the common development and distribution license)"),
    ("epl", "recipient s acceptance of this agreement", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("epl-2.0", "this source code may also be made available under the following secondary licenses", "this source code may also be made available under the following secondary licenses"),
    ("cpl", "the accompanying program is provided under the terms of this common public license", "the accompanying program is provided under the terms of this common public license"),
    ("ipl", "the accompanying program is provided under the terms of this ibm public license", "the accompanying program is provided under the terms of this ibm public license"),
    ("eupl", "licensed under the eupl", "licensed under the(?= eupl)"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "this license establishes the terms under which a given free software package", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("perl", "the same terms as perl itself", "(?:under )?the same terms as perl itself"),
    ("bsl-1.0", "distributed under the boost software license", "distributed under the boost software license version 1 0"),
    ("bsl", "must be included in all copies of the software in whole or in part", "must be included in all copies of the software in whole or in part and all derivative works of the software"),
    ("zlib", "permission is granted to anyone to use this software for any purpose", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("zlib", "an acknowledgment in the product documentation would be appreciated", "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"),
    ("libpng", "this code is released under the libpng license", "this code is released under the libpng license"),
    ("libtiff", "in no event shall sam leffler or silicon graphics be liable", "in no event shall sam leffler or silicon graphics be liable"),
    ("ijg", "this software is based in part on the work of the independent jpeg group", "this software is based in part on the work of the independent jpeg group"),
    ("curl", "except as contained in this notice the name of a copyright holder", "except as contained in this notice the name of a copyright holder shall not be used in advertising"),
    ("openssl", "this product includes software developed by the openssl project", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "this product includes cryptographic software written by eric young", "this product includes cryptographic software written by eric young"),
    ("ofl-1.1", "this font software is licensed under the sil open font license", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl", "the goals of the open font license", "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects"),
    ("python", "python software foundation license version 2", "(?:the )?python software foundation license version 2"),
    ("python", "psf is making python available to licensee on an as is basis", "psf is making python available to licensee on an as is basis"),
    ("php", "this product includes php software freely available from", "this product includes php software freely available from(?: https?)? (?:www )?php net"),
    ("ruby", "you may make and give away verbatim copies of the source form of the software", "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ncsa", "university of illinois ncsa open source license", "(?:the )?university of illinois ncsa open source license"),
    ("unicode", "unicode inc license agreement", "unicode inc license agreement data files and software"),
    ("w3c", "notice and license", "w3c software (?:and document )?notice and license"),
    ("vim", "there are no restrictions on distributing unmodified copies of vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("sqlite-blessing", "may you do good and not evil", "may you do good and not evil may you find forgiveness for yourself and forgive others"),
    ("json", "the software shall be used for good not evil", "the software shall be used for good not evil"),
    ("unlicense", "in jurisdictions that recognize copyright laws", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("unlicense", "for more information please refer to", "for more information please refer to(?: https?)? unlicense org"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("cc0", "to the extent possible under law", "to the extent possible under law .{1,80}? waived all copyright"),
    ("cc0", "the person who associated a work with this deed has dedicated the work", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("public-domain-mark", "this work has been identified as being free of known restrictions", "this work has been identified as being free of known restrictions under copyright law"),
    ("creative-commons", "the work as defined below is provided under the terms of this creative commons public license", "the work as defined below is provided under the terms of this creative commons public license"),
    ("creative-commons", "by exercising the licensed rights", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons"),
    ("creative-commons", "this work is licensed under a creative commons", "this work is licensed under a(?= creative commons)"),
    ("odbl", "the open database license odbl is a license agreement", "the open database license odbl is a license agreement intended to allow users to freely share modify and use this database"),
    ("odc-by", "open data commons attribution license", "(?:the )?open data commons attribution license(?: v?1 0)?"),
    ("ogl", "contains public sector information licensed under the open government", "contains public sector information licensed under the open government licen[sc]e(?: v[123] 0)?"),
    ("ms-pl", "this license governs use of the accompanying software", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-rl", "reciprocal grants for any file you distribute", "reciprocal grants for any file you distribute that contains code from the software"),
    ("osl-3.0", "licensed under the open software license version", "licensed under the open software license version 3 0"),
    ("busl", "the licensor hereby grants you the right to copy modify create derivative works", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic", "you may not provide the software to third parties as a hosted or managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "the license does not grant to you the right to sell the software", "(?:the grant of rights under )?the license (?:will not include and the license )?does not grant to you the right to sell the software"),
    ("polyform", "the licensor grants you a copyright license for the software", "the licensor grants you a copyright license for the software to do everything you might do with the software"),
    ("beerware", "you can buy me a beer in return", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("proprietary", "unauthorized copying of this file", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "no part of this publication may be reproduced", "no part of this publication may be reproduced (?:distributed )?(?:stored in a retrieval system )?or transmitted in any form"),
    ("proprietary", "by installing copying or otherwise using the software", "by installing copying or otherwise using the software you agree to be bound by the terms"),
)

#: What may stand behind "SPDX-License-Identifier:", as (label, words).
SPDX = (
    ("0bsd", "0bsd"),
    ("afl-3.0", "afl 3 0"),
    ("agpl-3.0", "agpl 3 0 only"),
    ("agpl-3.0", "agpl 3 0 or later"),
    ("apache-1.1", "apache 1 1"),
    ("apache-2.0", "apache 2 0"),
    ("artistic-1.0", "artistic 1 0"),
    ("artistic-2.0", "artistic 2 0"),
    ("beerware", "beerware"),
    ("blueoak-1.0.0", "blueoak 1 0 0"),
    ("bsd-1-clause", "bsd 1 clause"),
    ("bsd-2-clause", "bsd 2 clause"),
    ("bsd-2-clause-patent", "bsd 2 clause patent"),
    ("bsd-3-clause", "bsd 3 clause"),
    ("bsd-3-clause-clear", "bsd 3 clause clear"),
    ("bsd-4-clause", "bsd 4 clause"),
    ("bsl-1.0", "bsl 1 0"),
    ("busl-1.1", "busl 1 1"),
    ("cc-by-4.0", "cc by 4 0"),
    ("cc-by-sa-4.0", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "cc by nc 4 0"),
    ("cc0-1.0", "cc0 1 0"),
    ("cddl-1.0", "cddl 1 0"),
    ("cddl-1.1", "cddl 1 1"),
    ("cecill-2.1", "cecill 2 1"),
    ("cpl-1.0", "cpl 1 0"),
    ("curl", "curl"),
    ("ecl-2.0", "ecl 2 0"),
    ("elastic-2.0", "elastic 2 0"),
    ("epl-1.0", "epl 1 0"),
    ("epl-2.0", "epl 2 0"),
    ("eupl-1.2", "eupl 1 2"),
    ("gfdl-1.3", "gfdl 1 3 only"),
    ("gfdl-1.3", "gfdl 1 3 or later"),
    ("gpl-1.0", "gpl 1 0 or later"),
    ("gpl-2.0", "gpl 2 0"),
    ("gpl-2.0", "gpl 2 0 only"),
    ("gpl-2.0", "gpl 2 0 or later"),
    ("gpl-3.0", "gpl 3 0"),
    ("gpl-3.0", "gpl 3 0 only"),
    ("gpl-3.0", "gpl 3 0 or later"),
    ("hpnd", "hpnd"),
    ("ijg", "ijg"),
    ("ipl-1.0", "ipl 1 0"),
    ("isc", "isc"),
    ("lgpl-2.0", "lgpl 2 0 only"),
    ("lgpl-2.1", "lgpl 2 1"),
    ("lgpl-2.1", "lgpl 2 1 only"),
    ("lgpl-2.1", "lgpl 2 1 or later"),
    ("lgpl-3.0", "lgpl 3 0"),
    ("lgpl-3.0", "lgpl 3 0 only"),
    ("lgpl-3.0", "lgpl 3 0 or later"),
    ("libpng-2.0", "libpng 2 0"),
    ("mit", "mit"),
    ("mit-0", "mit 0"),
    ("mpl-1.1", "mpl 1 1"),
    ("mpl-2.0", "mpl 2 0"),
    ("ms-pl", "ms pl"),
    ("ms-rl", "ms rl"),
    ("mulanpsl-2.0", "mulanpsl 2 0"),
    ("ncsa", "ncsa"),
    ("odbl-1.0", "odbl 1 0"),
    ("ofl-1.1", "ofl 1 1"),
    ("openssl", "openssl"),
    ("osl-3.0", "osl 3 0"),
    ("php-3.01", "php 3 01"),
    ("postgresql", "postgresql"),
    ("psf-2.0", "psf 2 0"),
    ("python-2.0", "python 2 0"),
    ("qpl-1.0", "qpl 1 0"),
    ("ruby", "ruby"),
    ("sspl-1.0", "sspl 1 0"),
    ("unicode-3.0", "unicode 3 0"),
    ("unlicense", "unlicense"),
    ("upl-1.0", "upl 1 0"),
    ("vim", "vim"),
    ("w3c", "w3c"),
    ("wtfpl", "wtfpl"),
    ("x11", "x11"),
    ("zlib", "zlib"),
    ("zpl-2.1", "zpl 2 1"),
)


def rules() -> tuple[Rule, ...]:
    """All signatures in order: whole sentences, versions, names, short identifiers, mentions."""
    out: list[Rule] = []
    out += [Rule(label, key, text, trust) for label, key, text, trust in PHRASES if trust == 1.0]
    out += [Rule(label, key, text, 1.0) for label, key, text in SENTENCES]
    for label, words in SPDX:
        out.append(Rule(label, "spdx license identifier", rf"spdx license identifier {words}", 1.0))
    for label, key, name, versions in VERSIONED:
        for version in versions:
            short = version.removesuffix(" 0")
            number = version if short == version else f"{short}(?: 0)?"
            named = rf"{name}(?: version| v)? ?{number}"
            out.append(Rule(f"{label}-{version.replace(' ', '.')}", key, rf"{named} or (?:any )?later(?: version)?", 1.0))
            out.append(Rule(f"{label}-{version.replace(' ', '.')}", key, named, 1.0))
            written = rf"version {number} of the {name}"
            out.append(Rule(f"{label}-{version.replace(' ', '.')}", key, written, 1.0))
    for label, short, long in COMMONS:
        for version in COMMONS_VERSIONS:
            dotted = f"{label}-{version.replace(' ', '.')}"
            out.append(Rule(dotted, f" cc {short} ", rf"cc {short} {version}", 1.0))
            out.append(Rule(dotted, "creative commons", rf"creative commons {long} {version}", 1.0))
            out.append(Rule(dotted, "creativecommons", rf"creativecommons org licenses {short} {version}", 1.0))
    for label, short, long in COMMONS:
        out.append(Rule(label, f" cc {short} ", rf"cc {short}", 0.9))
        out.append(Rule(label, "creative commons", rf"creative commons {long}", 0.9))
    for label, key, name, _ in VERSIONED:
        out.append(Rule(label, key, name, 0.9))
    for label, first, versions in IDENTIFIERS:
        for version in versions:
            dotted = f"{label}-{version.replace(' ', '.')}"
            named = rf"{first} ?(?:v|version)? ?{version}"
            out.append(Rule(dotted, f" {first}", rf"{named}(?: only| or (?:any )?later(?: version)?)?", 0.8))
    out += [Rule(label, key, text, trust) for label, key, text, trust in PHRASES if trust < 1.0]
    return tuple(out)


def normal(text: Column) -> Column:
    """The words in lower case, one blank before, between and after them; one blank for none.

    Only A-Z matter to the rules; the sign that lower-cases to an ASCII k from outside is kept out.
    """
    safe = F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ue000"))
    spaced = F.regexp_replace(safe, BETWEEN, " ")
    return F.lower(F.concat(F.lit(" "), F.trim(spaced), F.lit(" ")))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def word_count(spaced: Column) -> Column:
    return F.when(spaced == "  ", 0).otherwise(F.regexp_count(spaced, F.lit(" ")) - 1).cast("long")


def _starts(spaced: Column, pattern: Column, inside: Column | int) -> Column:
    """Places of the matches, as numbers of the words they begin and end at (end not included).

    `inside` is the number of words of each match, or a column of one number for each match.
    Every gap between matches begins and ends with a blank, so it has one blank more than words.
    """
    gaps = F.transform(F.split(spaced, pattern, -1), lambda gap: _blanks(gap) - 1)
    if isinstance(inside, int):
        lengths = F.transform(F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda _: F.lit(inside))
    else:
        lengths = inside
    pairs = F.arrays_zip(gaps.alias("gap"), lengths.alias("words"))
    empty = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found")
    )

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + pair["words"]
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.when(
            pair["words"].isNotNull(),
            F.struct(end.alias("at"), F.concat(state["found"], one).alias("found")),
        ).otherwise(state)

    return F.aggregate(pairs, empty, step, lambda state: state["found"])


def _whole_words(pattern: str) -> str:
    return rf"(?<= ){pattern}(?= )"


def detections(spaced: Column, given: tuple[Rule, ...] | None = None) -> Column:
    """Array of (label, trust, rank, start, end) for all rules' matches in a text from normal().

    The rules are one constant of the plan; a text is searched only by rules whose keyword it
    holds, which is a plain search for a substring.
    """
    by_keyword: dict[str, list[tuple[int, Rule]]] = {}
    for rank, rule in enumerate(rules() if given is None else given):
        by_keyword.setdefault(rule.keyword, []).append((rank, rule))

    def constant(rank: int, rule: Rule) -> Column:
        return F.struct(
            F.lit(rank).alias("rank"),
            F.lit(rule.label).alias("label"),
            F.lit(_whole_words(rule.pattern)).alias("pattern"),
            F.lit(rule.trust).alias("trust"),
        )

    table = F.array(
        *[
            F.struct(
                F.lit(keyword).alias("keyword"),
                F.array(*[constant(rank, rule) for rank, rule in held]).alias("rules"),
            )
            for keyword, held in by_keyword.items()
        ]
    )

    def search(rule: Column) -> Column:
        lengths = F.transform(
            F.regexp_extract_all(spaced, rule["pattern"], F.lit(0)), lambda m: _blanks(m) + 1
        )
        return F.transform(
            _starts(spaced, rule["pattern"], lengths),
            lambda place: F.struct(
                rule["label"].alias("label"),
                rule["trust"].alias("trust"),
                rule["rank"].alias("rank"),
                place["start"].alias("start"),
                place["end"].alias("end"),
            ),
        )

    hit = F.filter(table, lambda entry: F.contains(spaced, entry["keyword"]))
    return F.flatten(F.transform(F.flatten(F.transform(hit, lambda entry: entry["rules"])), search))


def suppress(found: Column) -> Column:
    """The detections that stay: none lies within another, and of two that overlap one is left.

    Sorted by start, longest first, then by rank, a detection lies within an earlier one if it
    ends no later than the furthest end so far; so one of equal place and better rank takes it
    too. Those left have rising starts and ends, and each that overlaps the one kept before it
    goes unless its rank is better, in which case it takes that one's place.
    """
    order = F.array_sort(
        F.transform(
            found,
            lambda d: F.struct(
                d["start"].alias("start"),
                (-d["end"]).alias("back"),
                d["rank"].alias("rank"),
                d["label"].alias("label"),
                d["trust"].alias("trust"),
                d["end"].alias("end"),
            ),
        )
    )
    kind = "array<struct<start:int,back:int,rank:int,label:string,trust:double,end:int>>"

    def step(kept: Column, d: Column) -> Column:
        last = F.element_at(kept, -1)
        none = F.size(kept) == 0
        return (
            F.when(none, F.array(d))
            .when(d["end"] <= last["end"], kept)
            .when(d["start"] >= last["end"], F.concat(kept, F.array(d)))
            .when(d["rank"] < last["rank"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(d)))
            .otherwise(kept)
        )

    return F.coalesce(F.aggregate(order, F.array().cast(kind), step), F.array().cast(kind))


def _base_places(spaced: Column, phrase: str, label: str) -> Column:
    places = _starts(spaced, F.lit(_whole_words(phrase)), len(phrase.split()))
    return F.transform(
        places,
        lambda place: F.struct(
            F.lit(label).alias("label"), place["start"].alias("start"), place["end"].alias("end")
        ),
    )


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (keep..., n_words, base, detections) of whole texts.

    `base` has a row (label, start, end) for every place where a fixed phrase's words stand
    one after the other; `detections` has what the ordered signatures leave after suppression.
    Words are counted from 0. Everything is computed within the row: nothing is shuffled.

    Null and empty texts have no words and empty arrays. Repeated rows are rows of their own.
    Columns named as the new ones are not kept.
    """
    new = ("n_words", "base", "detections")
    kept = [name for name in keep if name.lower() not in new]
    (name,) = fresh(docs, "spaced")
    rows = docs.select(*kept, normal(F.col(text)).alias(name))
    spaced = F.col(name)
    base = F.concat(*[_base_places(spaced, phrase, label) for phrase, label in BASE])
    held = F.lit(False)
    for phrase, _ in BASE:
        held = held | spaced.contains(f" {phrase} ")
    keywords = sorted({rule.keyword for rule in rules()})
    gate = F.lit(False)
    for word in _stems(keywords):
        gate = gate | spaced.contains(word)
    empty_base = F.array().cast("array<struct<label:string,start:int,end:int>>")
    kind = "array<struct<start:int,back:int,rank:int,label:string,trust:double,end:int>>"
    return rows.select(
        *kept,
        word_count(spaced).alias("n_words"),
        F.when(held, base).otherwise(empty_base).alias("base"),
        F.when(gate, suppress(detections(spaced))).otherwise(F.array().cast(kind)).alias("detections"),
    )


def _stems(keywords: list[str]) -> list[str]:
    """A few texts of which every keyword holds one: the first gate."""
    common = ["licen", " cc ", "creative commons", "creativecommons", "permission", "copyright", "software"]
    return common + [key for key in keywords if not any(stem in key for stem in common)]

"""Passages of public licences, as published: label, passage, mandatory key phrase."""
from __future__ import annotations

#: Wording of the licences themselves, alphabetical by label.
PASSAGES = (
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "affero general public license"),
    ("apache", "Licensed under the Apache License, Version 2.0", "apache license"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache license"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "specific language governing permissions and limitations"),
    ("artistic", "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package", "semblance of artistic control"),
    ("boost", "Distributed under the Boost Software License, Version 1.0.", "boost software license"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software", "accompanying documentation covered by this license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "retain the above copyright notice"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "redistributions in binary form must reproduce"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "endorse or promote products"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "dedicated the work to the public domain"),
    ("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License.", "common development and distribution license"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", "eclipse public license"),
    ("eupl", "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL", "european commission"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gnu general public license"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "gnu general public license"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "copy modify and or distribute this software"),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", "the author disclaims all warranties"),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation", "lesser general public license"),
    ("lgpl", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.", "lesser general public license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", "merge publish distribute sublicense and or sell"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "copies or substantial portions of the software"),
    ("mit", "released under the MIT License", "mit license"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one", "mozilla public license"),
    ("mspl", "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software.", "this license governs use of the accompanying software"),
    ("ncsa", "to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "to deal with the software without restriction"),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "sil open font license"),
    ("openssl", "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit", "software developed by the openssl project"),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.", "following two paragraphs appear in all copies"),
    ("psf", "PSF is making Python available to Licensee on an \"AS IS\" basis. PSF makes no representations or warranties, express or implied.", "psf is making python available to licensee"),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "free and unencumbered software"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "anyone is free to copy modify publish use compile sell"),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.", "verbatim or modified copies of this license document"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "alter it and redistribute it freely"),
    ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "origin of this software must not be misrepresented"),
    ("zpl", "This software is subject to the provisions of the Zope Public License, Version 2.1 (ZPL). A copy of the ZPL should accompany this distribution.", "zope public license"),
)

"""The dictionaries that come with the package, in a short notation.

A field is "number name TYPE"; an entry is a field's name, `!` behind it if required, `@` before a component's name, and
a group as name( entries ). FIX44 is a subset for order flow, allocations and snapshots; FIXT11 is whole. Other versions
come from XML files.
"""

#: The transport dictionary.
FIXT11 = {
    "type": "FIXT", "major": "1", "minor": "1", "servicepack": "0",
    "header": "BeginString! BodyLength! MsgType! ApplVerID ApplExtID CstmApplVerID SenderCompID! TargetCompID! OnBehalfOfCompID DeliverToCompID SecureDataLen SecureData MsgSeqNum! SenderSubID SenderLocationID TargetSubID TargetLocationID OnBehalfOfSubID OnBehalfOfLocationID DeliverToSubID DeliverToLocationID PossDupFlag PossResend SendingTime! OrigSendingTime XmlDataLen XmlData MessageEncoding LastMsgSeqNumProcessed NoHops( HopCompID HopSendingTime HopRefID )",
    "trailer": "SignatureLength Signature CheckSum!",
    "messages": {
        "0 Heartbeat admin": "TestReqID", "1 TestRequest admin": "TestReqID!", "2 ResendRequest admin": "BeginSeqNo! EndSeqNo!",
        "3 Reject admin": "RefSeqNum! RefTagID RefMsgType RefApplVerID RefApplExtID RefCstmApplVerID SessionRejectReason Text EncodedTextLen EncodedText",
        "4 SequenceReset admin": "GapFillFlag NewSeqNo!", "5 Logout admin": "SessionStatus Text EncodedTextLen EncodedText",
        "A Logon admin": "EncryptMethod! HeartBtInt! RawDataLength RawData ResetSeqNumFlag NextExpectedMsgSeqNum MaxMessageSize @MsgTypeGrp TestMessageIndicator Username Password NewPassword EncryptedPasswordMethod EncryptedPasswordLen EncryptedPassword EncryptedNewPasswordLen EncryptedNewPassword SessionStatus DefaultApplVerID! DefaultApplExtID DefaultCstmApplVerID Text EncodedTextLen EncodedText",
        "n XMLnonFIX admin": "",
    },
    "components": {"HopGrp": "NoHops( HopCompID HopSendingTime HopRefID )", "MsgTypeGrp": ""},
    "fields": """
7 BeginSeqNo SEQNUM
8 BeginString STRING
9 BodyLength LENGTH
10 CheckSum STRING
16 EndSeqNo SEQNUM
34 MsgSeqNum SEQNUM
35 MsgType STRING
36 NewSeqNo SEQNUM
43 PossDupFlag BOOLEAN
45 RefSeqNum SEQNUM
49 SenderCompID STRING
50 SenderSubID STRING
52 SendingTime UTCTIMESTAMP
56 TargetCompID STRING
57 TargetSubID STRING
58 Text STRING
89 Signature DATA
90 SecureDataLen LENGTH
91 SecureData DATA
93 SignatureLength LENGTH
95 RawDataLength LENGTH
96 RawData DATA
97 PossResend BOOLEAN
98 EncryptMethod INT
108 HeartBtInt INT
112 TestReqID STRING
115 OnBehalfOfCompID STRING
116 OnBehalfOfSubID STRING
122 OrigSendingTime UTCTIMESTAMP
123 GapFillFlag BOOLEAN
128 DeliverToCompID STRING
129 DeliverToSubID STRING
141 ResetSeqNumFlag BOOLEAN
142 SenderLocationID STRING
143 TargetLocationID STRING
144 OnBehalfOfLocationID STRING
145 DeliverToLocationID STRING
212 XmlDataLen LENGTH
213 XmlData DATA
347 MessageEncoding STRING
354 EncodedTextLen LENGTH
355 EncodedText DATA
369 LastMsgSeqNumProcessed SEQNUM
371 RefTagID INT
372 RefMsgType STRING
373 SessionRejectReason INT
383 MaxMessageSize LENGTH
464 TestMessageIndicator BOOLEAN
553 Username STRING
554 Password STRING
627 NoHops NUMINGROUP
628 HopCompID STRING
629 HopSendingTime UTCTIMESTAMP
630 HopRefID SEQNUM
789 NextExpectedMsgSeqNum SEQNUM
925 NewPassword STRING
1128 ApplVerID STRING
1129 CstmApplVerID STRING
1130 RefApplVerID STRING
1131 RefCstmApplVerID STRING
1137 DefaultApplVerID STRING
1156 ApplExtID INT
1400 EncryptedPasswordMethod INT
1401 EncryptedPasswordLen LENGTH
1402 EncryptedPassword DATA
1403 EncryptedNewPasswordLen LENGTH
1404 EncryptedNewPassword DATA
1406 RefApplExtID INT
1407 DefaultApplExtID INT
1408 DefaultCstmApplVerID STRING
1409 SessionStatus INT
""",
    "enums": """
43 N NO
43 Y YES
97 N NO
97 Y YES
98 0 NONE_OTHER
98 1 PKCS
98 2 DES
98 3 PKCSDES
98 4 PGPDES
98 5 PGPDESMD5
98 6 PEMDESMD5
123 N NO
123 Y YES
141 N NO
141 Y YES
373 0 INVALID_TAG_NUMBER
373 1 REQUIRED_TAG_MISSING
373 2 TAG_NOT_DEFINED_FOR_THIS_MESSAGE_TYPE
373 3 UNDEFINED_TAG
373 4 TAG_SPECIFIED_WITHOUT_A_VALUE
373 5 VALUE_IS_INCORRECT
373 6 INCORRECT_DATA_FORMAT_FOR_VALUE
373 7 DECRYPTION_PROBLEM
373 8 SIGNATURE_PROBLEM
373 9 COMPID_PROBLEM
373 10 SENDINGTIME_ACCURACY_PROBLEM
373 11 INVALID_MSGTYPE
373 12 XML_VALIDATION_ERROR
373 13 TAG_APPEARS_MORE_THAN_ONCE
373 14 TAG_SPECIFIED_OUT_OF_REQUIRED_ORDER
373 15 REPEATING_GROUP_FIELDS_OUT_OF_ORDER
373 16 INCORRECT_NUMINGROUP_COUNT_FOR_REPEATING_GROUP
373 17 NON_DATA_VALUE_INCLUDES_FIELD_DELIMITER
373 18 INVALID_UNSUPPORTED_APPLICATION_VERSION
373 99 OTHER
464 N NO
464 Y YES
1128 0 FIX27
1128 1 FIX30
1128 2 FIX40
1128 3 FIX41
1128 4 FIX42
1128 5 FIX43
1128 6 FIX44
1128 7 FIX50
1128 8 FIX50_SP1
1128 9 FIX50_SP2
1409 0 SESSION_ACTIVE
1409 1 SESSION_PASSWORD_CHANGED
1409 2 SESSION_PASSWORD_DUE_TO_EXPIRE
1409 3 NEW_SESSION_PASSWORD_DOES_NOT_COMPLY_WITH_POLICY
1409 4 SESSION_LOGOUT_COMPLETE
1409 5 INVALID_USERNAME_OR_PASSWORD
1409 6 ACCOUNT_LOCKED
1409 7 LOGONS_ARE_NOT_ALLOWED_AT_THIS_TIME
1409 8 PASSWORD_EXPIRED
""",
}

#: A subset of the FIX 4.4 dictionary.
FIX44 = {
    "type": "FIX", "major": "4", "minor": "4", "servicepack": "0",
    "header": "BeginString! BodyLength! MsgType! SenderCompID! TargetCompID! MsgSeqNum! SenderSubID TargetSubID PossDupFlag PossResend SendingTime!",
    "trailer": "CheckSum!",
    "messages": {
        "0 Heartbeat admin": "TestReqID", "1 TestRequest admin": "TestReqID!", "5 Logout admin": "Text", "A Logon admin": "EncryptMethod! HeartBtInt!",
        "8 ExecutionReport app": "OrderID! ClOrdID OrigClOrdID @Parties ExecID! ExecType! OrdStatus! Account Symbol! Side! OrderQty OrdType Price LastQty LastPx LeavesQty! CumQty! AvgPx! TradeDate TransactTime Text",
        "9 OrderCancelReject app": "OrderID! ClOrdID! OrigClOrdID! OrdStatus! TransactTime Text", "D NewOrderSingle app": "ClOrdID! @Parties Account NoAllocs( AllocAccount AllocQty ) Symbol! Side! TransactTime! OrderQty OrdType! Price Text",
        "F OrderCancelRequest app": "OrigClOrdID! OrderID ClOrdID! @Parties Account Symbol! Side! TransactTime! OrderQty Text",
        "G OrderCancelReplaceRequest app": "OrderID @Parties OrigClOrdID! ClOrdID! Account Symbol! Side! TransactTime! OrderQty OrdType! Price Text",
        "H OrderStatusRequest app": "OrderID ClOrdID! @Parties Account Symbol! Side!",
        "J AllocationInstruction app": "AllocID! AllocTransType! AllocType! AllocNoOrdersType! NoOrders( ClOrdID OrderID ) Side! Symbol! Quantity! AvgPx! @Parties TradeDate! TransactTime Text NoAllocs( AllocAccount AllocQty )",
        "W MarketDataSnapshotFullRefresh app": "MDReqID Symbol! NoMDEntries!( MDEntryType! MDEntryPx MDEntrySize MDEntryDate MDEntryTime )",
    },
    "components": {"Parties": "NoPartyIDs( PartyID PartyIDSource PartyRole NoPartySubIDs( PartySubID PartySubIDType ) )"},
    "fields": """
1 Account STRING
6 AvgPx PRICE
8 BeginString STRING
9 BodyLength LENGTH
10 CheckSum STRING
11 ClOrdID STRING
14 CumQty QTY
17 ExecID STRING
31 LastPx PRICE
32 LastQty QTY
34 MsgSeqNum SEQNUM
35 MsgType STRING
37 OrderID STRING
38 OrderQty QTY
39 OrdStatus CHAR
40 OrdType CHAR
41 OrigClOrdID STRING
43 PossDupFlag BOOLEAN
44 Price PRICE
49 SenderCompID STRING
50 SenderSubID STRING
52 SendingTime UTCTIMESTAMP
53 Quantity QTY
54 Side CHAR
55 Symbol STRING
56 TargetCompID STRING
57 TargetSubID STRING
58 Text STRING
60 TransactTime UTCTIMESTAMP
70 AllocID STRING
71 AllocTransType CHAR
73 NoOrders NUMINGROUP
75 TradeDate LOCALMKTDATE
78 NoAllocs NUMINGROUP
79 AllocAccount STRING
80 AllocQty QTY
97 PossResend BOOLEAN
98 EncryptMethod INT
108 HeartBtInt INT
112 TestReqID STRING
150 ExecType CHAR
151 LeavesQty QTY
262 MDReqID STRING
268 NoMDEntries NUMINGROUP
269 MDEntryType CHAR
270 MDEntryPx PRICE
271 MDEntrySize QTY
272 MDEntryDate UTCDATEONLY
273 MDEntryTime UTCTIMEONLY
447 PartyIDSource CHAR
448 PartyID STRING
452 PartyRole INT
453 NoPartyIDs NUMINGROUP
523 PartySubID STRING
626 AllocType INT
802 NoPartySubIDs NUMINGROUP
803 PartySubIDType INT
857 AllocNoOrdersType INT
""",
    "enums": """
35 0 HEARTBEAT
35 1 TEST_REQUEST
35 5 LOGOUT
35 8 EXECUTION_REPORT
35 9 ORDER_CANCEL_REJECT
35 A LOGON
35 D NEW_ORDER_SINGLE
35 F ORDER_CANCEL_REQUEST
35 G ORDER_CANCEL_REPLACE_REQUEST
35 H ORDER_STATUS_REQUEST
35 J ALLOCATION_INSTRUCTION
35 W MARKET_DATA_SNAPSHOT_FULL_REFRESH
39 0 NEW
39 1 PARTIALLY_FILLED
39 2 FILLED
39 3 DONE_FOR_DAY
39 4 CANCELED
39 5 REPLACED
39 6 PENDING_CANCEL
39 7 STOPPED
39 8 REJECTED
39 9 SUSPENDED
39 A PENDING_NEW
39 B CALCULATED
39 C EXPIRED
39 D ACCEPTED_FOR_BIDDING
39 E PENDING_REPLACE
40 1 MARKET
40 2 LIMIT
40 3 STOP
40 4 STOP_LIMIT
43 N NO
43 Y YES
54 1 BUY
54 2 SELL
71 0 NEW
71 1 REPLACE
71 2 CANCEL
97 N NO
97 Y YES
150 0 NEW
150 3 DONE_FOR_DAY
150 4 CANCELED
150 5 REPLACED
150 6 PENDING_CANCEL
150 7 STOPPED
150 8 REJECTED
150 9 SUSPENDED
150 A PENDING_NEW
150 B CALCULATED
150 C EXPIRED
150 D RESTATED
150 E PENDING_REPLACE
150 F TRADE
150 G TRADE_CORRECT
150 H TRADE_CANCEL
150 I ORDER_STATUS
269 0 BID
269 1 OFFER
447 B BIC
447 D PROPRIETARY
452 1 EXECUTING_FIRM
452 5 INVESTOR_ID
626 5 READY_TO_BOOK
803 10 SECURITIES_ACCOUNT_NUMBER
857 1 EXPLICIT_LIST_PROVIDED
""",
}

#: Which dictionary an ApplVerID names.
APPL_VERSIONS = {"0": "FIX27", "1": "FIX30", "2": "FIX40", "3": "FIX41", "4": "FIX42", "5": "FIX43", "6": "FIX44", "7": "FIX50", "8": "FIX50SP1", "9": "FIX50SP2"}
#: Keys in the order in which they are listed; FIX27 and FIX30 stand for FIX40.
CATALOG = ("FIX27", "FIX30", "FIX40", "FIX41", "FIX42", "FIX43", "FIX44", "FIX50", "FIX50SP1", "FIX50SP2", "FIXT11")
ALIASES = {"FIX27": "FIX40", "FIX30": "FIX40"}

#: Tags whose values are hidden, and what their aliases start with.
SENSITIVE = """
1 Account
49 SenderCompID
50 SenderSubID
56 TargetCompID
57 TargetSubID
79 AllocAccount
115 OnBehalfOfCompID
116 OnBehalfOfSubID
128 DeliverToCompID
129 DeliverToSubID
142 SenderLocationID
143 TargetLocationID
144 OnBehalfOfLocationID
145 DeliverToLocationID
283 LocationID
440 ClearingAccount
523 PartySubID
545 NestedPartySubID
553 Username
554 Password
581 AccountType
625 TradingSessionSubID
628 HopCompID
671 LegAllocAccount
717 SettlSessSubID
760 Nested2PartySubID
785 SettlPartySubID
786 SettlPartySubIDType
798 AllocAccountType
801 NoSettlPartySubIDs
802 NoPartySubIDs
803 PartySubIDType
804 NoNestedPartySubIDs
805 NestedPartySubIDType
806 NoNested2PartySubIDs
807 Nested2PartySubIDType
809 NoUsernames
823 UnderlyingTradingSessionSubID
925 NewPassword
930 RefCompID
931 RefSubID
936 NoCompIDs
952 NoNested3PartySubIDs
953 Nested3PartySubID
954 Nested3PartySubIDType
1052 NoInstrumentPartySubIDs
1053 InstrumentPartySubID
1054 InstrumentPartySubIDType
1062 NoUndlyInstrumentPartySubIDs
1063 UndlyInstrumentPartySubID
1064 UndlyInstrumentPartySubIDType
1114 TriggerTradingSessionSubID
1120 NoRootPartySubIDs
1121 RootPartySubID
1122 RootPartySubIDType
1296 NoDerivativeInstrumentPartySubIDs
1297 DerivativeInstrumentPartySubID
1298 DerivativeInstrumentPartySubIDType
1400 EncryptedPasswordMethod
1401 EncryptedPasswordLen
1402 EncryptedPassword
1403 EncryptedNewPasswordLen
1404 EncryptedNewPassword
1411 Nested4PartySubIDType
1412 Nested4PartySubID
1413 NoNested4PartySubIDs
1519 NoPartyDetailAltSubIDs
1520 PartyDetailAltSubID
1521 PartyDetailAltSubIDType
1566 NoRelatedPartyDetailSubIDs
1567 RelatedPartyDetailSubID
1568 RelatedPartyDetailSubIDType
1572 NoRelatedPartyDetailAltSubIDs
1573 RelatedPartyDetailAltSubID
1574 RelatedPartyDetailAltSubIDType
1661 NoRequestingPartySubIDs
1662 RequestingPartySubID
1663 RequestingPartySubIDType
1694 NoPartyDetailSubIDs
1695 PartyDetailSubID
1696 PartyDetailSubIDType
1699 AccountSummaryReportID
1816 ClearingAccountType
1817 LegClearingAccountType
1891 TrdMatchSubID
1918 NoClearingAccountTypes
2258 NoLegInstrumentPartySubIDs
2259 LegInstrumentPartySubID
2260 LegInstrumentPartySubIDType
2433 NoTargetPartySubIDs
2434 TargetPartySubID
2435 TargetPartySubIDType
2567 PrimaryServiceLocationID
2568 SecondaryServiceLocationID
2674 FillMatchSubID
2680 LegAccount
2816 PostTradePaymentAccount
40178 NoProvisionPartySubIDs
40179 ProvisionPartySubID
40180 ProvisionPartySubIDType
40238 NoPaymentSettlPartySubIDs
40239 PaymentSettlPartySubID
40240 PaymentSettlPartySubIDType
40537 NoLegProvisionPartySubIDs
40538 LegProvisionPartySubID
40539 LegProvisionPartySubIDType
42177 NoUnderlyingProvisionPartySubIDs
42178 UnderlyingProvisionPartySubID
42179 UnderlyingProvisionPartySubIDType
"""
